"""Licence notices and texts that scans look for, and the phrases without which none of them counts."""

from __future__ import annotations

import re
from dataclasses import dataclass

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_in(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class Template:
    """phrases are mandatory; each stands within the text."""

    label: str
    text: str
    phrases: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return words_in(self.text)

    @property
    def keys(self) -> list[tuple[int, str]]:
        """(place in the text, word) of the mandatory phrases."""
        out = {}
        for phrase in self.phrases:
            part = words_in(phrase)
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(part)] == part)
            out |= {at + k: w for k, w in enumerate(part)}
        return sorted(out.items())


#: Phrases of which every place counts, and the labels they prove.
BASE_PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

# Public licence texts and the notices by which they are applied, as their publishers word them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."""
_AGPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
_LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
or non-commercial, and by any means."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely."""

TEMPLATES = (
    Template("mit", "Released under the MIT License", ("the MIT License",)),
    Template("mit", _MIT, ("Permission is hereby granted free of charge to any person obtaining a copy of this software",)),
    Template("isc", _ISC, ("Permission to use copy modify and or distribute this software", "with or without fee is hereby granted")),
    Template("bsd", _BSD, ("Redistribution and use in source and binary forms",)),
    Template("bsd-3", _BSD_3, ("may be used to endorse or promote products",)),
    Template("apache-2", "Licensed under the Apache License, Version 2.0", ("Apache License Version 2",)),
    Template("apache-2", _APACHE, ("Apache License Version 2", "you may not use this file except in compliance")),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("CC BY NC",)),
    Template("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License", ("Creative Commons Attribution",)),
    Template("gpl-3", "This work is licensed under the GNU General Public License version 3", ("GNU General Public License version 3",)),
    Template("gpl-3", _GPL.format(3), ("GNU General Public License as published by", "either version 3")),
    Template("gpl-2", "This program is licensed under the GNU General Public License version 2", ("GNU General Public License version 2",)),
    Template("gpl-2", _GPL.format(2), ("GNU General Public License as published by", "either version 2")),
    Template("agpl", _AGPL, ("GNU Affero General Public License",)),
    Template("lgpl", _LGPL, ("GNU Lesser General Public License",)),
    Template("mpl-2", _MPL, ("Mozilla Public License v 2 0",)),
    Template("unlicense", _UNLICENSE, ("free and unencumbered software released into the public domain",)),
    Template("zlib", _ZLIB, ("In no event will the authors be held liable",)),
)
