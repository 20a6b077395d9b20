"""Published results of the method, which every implementation of it must return."""

import numpy as np


def numbers(text: str) -> np.ndarray:
    return np.array(text.split(), dtype=float)


# Yearly landings of anchovy and sea surface temperature at Newport pier, 78 years, normalised.
ANCHOVY = numbers("""
-0.00759874 -0.00960162 -0.00844418 -0.0083536 -0.00774971 -0.00953117 -0.00996395 -0.00780004 -0.00745783 0.00347246
0.0241555 0.0872412 -0.0587879 -0.0633271 -0.0109906 0.044919 -0.060197 -0.00119757 0.381222 -0.193595
-0.180078 0.0274466 0.0393331 1.10901 0.67943 -1.00173 0.0440333 0.271627 -0.382782 -0.670421
-0.109504 -0.0565636 0.052538 -0.12137 0.0331634 0.00109718 0.00917916 1.28563 0.159526 -0.889802
2.37595 1.30074 -2.35977 1.10143 2.89919 -2.29245 3.46014 -1.5453 -0.623298 -4.53241
1.88048 -0.307508 0.454131 -0.510584 -1.91097 -0.0857413 -0.071862 -0.0127418 -0.0155096 -0.00372382
0.0408327 0.0301138 0.0324589 -0.15393 0.0338881 -0.0168885 -0.00304948 0.119509 0.0573892 -0.223024
0.179937 0.323007 0.367091 -0.741992 -0.157825 0.249897 0.213121 0.0730902
""")
TEMPERATURE = numbers("""
-0.347846 0.328734 1.61027 1.26534 0.0400459 -0.691345 -0.586502 0.665017 0.421038 0.551965
0.441628 0.777714 1.63382 1.59282 1.38009 0.331645 -0.0138251 -0.117138 0.35607 -0.0844464
-0.525395 -1.14218 -1.04257 -1.48325 -1.70846 -2.21847 -2.19432 -2.07212 -1.10831 0.268469
1.61014 1.44651 0.477878 -0.701946 -0.407587 -0.383447 -0.0187285 -0.0329409 0.337691 0.304107
0.051485 -0.294818 -0.772071 -0.708921 -0.712736 -0.637847 -1.38128 -0.838455 -0.305491 0.907717
0.29779 -0.102225 -0.296162 -0.043215 1.01859 1.67348 1.67402 1.20355 0.713725 0.77306
0.73088 0.718023 0.501144 0.897233 1.28284 1.96306 0.791977 -0.307302 -0.0387739 0.444062
-0.230065 -1.33349 -2.19937 -1.18642 -1.34262 -0.530206 -0.757965 -0.583363
""")

# Skill of convergent cross mapping between the two in both directions, for libraries of 10, 15, ... 75
# steps, of 100 samples each, in three dimensions, with the random stream of seed 42.
CCM_SIZES = list(range(10, 76, 5))
CCM_ANCHOVY = numbers("""
0.12485554814338684 0.1201137900352478 0.12218079715967178 0.12090811878442764 0.16469401121139526 0.17806583642959595 0.17201748490333557
0.19535359740257263 0.1987055391073227 0.21246008574962616 0.20203569531440735 0.21447935700416565 0.21210834383964539 0.2100672870874405
""")
CCM_TEMPERATURE = numbers("""
-0.04421072453260422 -0.056893762201070786 -0.04747771844267845 -0.08310048282146454 -0.03194859251379967 -0.04134418070316315 -0.04894541576504707
-0.0713227391242981 -0.056307077407836914 -0.08146516978740692 -0.05781849846243858 -0.06212713569402695 -0.05309828370809555 -0.056554295122623444
""")

# Temperature as predicted from anchovy one step ahead, in three dimensions.
CROSS_MAPPED = numbers("""
-0.010400 -0.031192 0.331990 0.268622 0.179362 0.248560 -0.177389 0.246132 0.362512 0.467970
0.124155 0.150723 0.697146 0.435925 0.533236 -0.056549 -0.543869 0.324306 0.312609 -0.221675
0.164055 0.215155 -0.631984 -0.128622 -0.463947 -0.766632 -0.047519 -0.247076 0.426001 -0.735366
0.423170 0.792514 1.319966 0.238767 0.259041 -1.679222 -1.157259 -1.245312 -0.540623 -1.274257
-0.650417 -0.342853 -0.799346 -1.069981 -0.134082 -0.533936 -0.636390 0.822755 -0.241240 -0.067588
-0.949656 0.083972 -0.325142 -0.415030 -0.178309 0.252636 0.437239 0.559425 0.665463 0.727301
0.227914 0.184212 -0.230767 -0.331590 0.408105 0.997201 0.937074 1.045494 0.573687 -0.294464
-0.062974 0.130195 -0.878802 -0.677013
""")

# Ten steps of a chaotic map, and the distances of the four nearest neighbours of each embedded row.
SHORT = numbers("""
0.555459324 0.625578552 0.21214047 0.997492374 0.115250742 0.514647729 0.464742146 0.993000176 0.646105189 0.940745315
""")
SHORT_NEIGHBOURS = {
    2: numbers("""
0.165933528 0.327943229 0.378455091 0.419342049 0.275886307 0.384327348 0.419342049 0.568615887 0.252641617 0.437659235 0.492469868 0.506149905
0.384327348 0.530873454 0.596056367 0.675150125 0.40250282 0.453970531 0.492469868 0.592423248 0.165933528 0.275886307 0.40250282 0.493821912
0.188740891 0.252641617 0.378455091 0.530610133 0.438022077 0.455136173 0.511579531 0.530873454 0.188740891 0.327943229 0.437659235 0.455136173
""").reshape(-1, 4),
    3: numbers("""
0.515340029 0.519515977 0.575806941 0.739823177 0.275922877 0.571440509 0.617127589 0.797350563 0.515340029 0.587906651 0.603879799 1.070409976
0.617127589 0.68072445 0.739823177 0.764267137 0.519515977 0.603879799 0.619562635 0.664127297 0.275922877 0.514241371 0.63394262 0.664127297
0.575806941 0.587906651 0.619562635 0.63394262 0.514241371 0.571440509 0.68072445 0.697284362
""").reshape(-1, 4),
    4: numbers("""
0.519535398 0.578596459 0.706197067 0.872209132 0.598280768 0.709218375 1.185838096 1.200218511 0.706197067 0.726080838 0.770384239 1.078451937
0.709218375 0.785491445 0.911680393 1.104271418 0.519535398 0.621762357 0.749267108 0.770384239 0.598280768 0.699067986 0.749267108 0.785491445
0.578596459 0.621762357 0.699067986 0.726080838
""").reshape(-1, 4),
    5: numbers("""
0.742780906 0.787945771 1.200912178 1.265545419 0.734505977 0.855459974 1.193102281 1.314559804 0.787945771 0.79144452 1.178828909 1.314559804
0.787227655 0.855459974 1.157476348 1.265545419 0.742780906 0.79144452 0.805117384 1.157476348 0.734505977 0.787227655 0.805117384 1.178828909
""").reshape(-1, 4),
}

# 200 steps of a chaotic map, and the second half as predicted from the first one step
# ahead in three dimensions.
TENT = numbers("""
0.039031 0.016319 0.077308 0.071431 0.063172 0.08239 0.075243 0.10002 0.095572 0.071431 0.14401 0.058408
0.062855 0.081914 0.11654 0.15688 0.15196 0.15021 0.14767 0.11685 0.12845 0.15307 0.11733 0.12003
0.16069 0.17419 0.1194 0.095255 0.097161 0.1078 0.11971 0.12384 0.16546 0.15402 0.1572 0.17197
0.2185 0.20405 0.17181 0.222 0.14989 0.13718 0.11257 0.097637 0.092872 0.072543 0.076355 0.085725
0.096684 0.091443 0.05539 0.069525 0.03236 0.048878 0.069684 0.068096 0.036013 0.12908 0.1032 0.086996
0.06206 0.061902 0.099861 0.10463 0.041572 0.059519 0.072384 0.068572 0.041572 0.016637 0.041096 -0.0046459
0.023625 -0.0079812 0.028072 -0.0089341 -0.014811 0.0025012 0.046654 -0.0024223 -0.026564 -0.033234 -0.0016282 -0.010999
-0.016875 -0.0073459 -0.013858 -0.006393 -0.015446 0.024578 -0.018146 -0.0052812 -0.012746 -0.031964 -0.010681 -0.068493
-0.0087753 -0.0016282 -0.00019879 -0.014017 0.010284 0.011395 -0.019258 -0.02164 -0.013699 -0.018781 -0.022911 -0.010681
-0.019893 0.015207 0.016001 0.00091298 0.0074248 0.0025012 0.01489 0.016795 0.025054 0.012825 0.0050424 0.0040895
0.054755 0.014731 0.049037 0.02569 0.019178 0.018384 0.013619 -0.017193 -0.037523 -0.0024223 -0.0068694 0.004566
-0.0097283 -0.0025812 -0.038793 -0.039111 -0.022752 -0.051499 -0.0033753 0.014254 0.0017071 -0.02434 -0.029264 -0.013699
-0.03244 -0.057217 -0.054993 -0.030058 -0.028787 -0.04324 -0.045146 -0.034664 -0.029105 -0.047846 -0.017352 -0.037681
-0.028152 -0.014334 -0.042446 -0.0048047 -0.042764 -0.032917 -0.022117 -0.027993 -0.014175 -0.03657 -0.039905 -0.045305
-0.026881 -0.02164 -0.052611 -0.055946 -0.078658 -0.043081 0.0044071 -0.024022 -0.0040106 0.009013 0.050466 0.036013
0.038396 0.04046 0.036331 0.055231 0.081119 0.0032954 0.018384 0.0096483 -0.0062341 -0.033075 -0.0011517 -0.03117
-0.036093 -0.021322 -0.030217 -0.016399 -0.011952 -0.043399 -0.019734 -0.043876
""")
TENT_PREDICTED = numbers("""
0.0059 0.0081 0.0033 -0.0045 -0.0273 -0.0063 0.0001 -0.0300 -0.0071 0.0034 -0.0011 0.0077 -0.0085 0.0069
-0.0002 -0.0038 -0.0012 0.0047 0.0022 0.0000 -0.0073 -0.0029 0.0268 0.0073 0.0217 -0.0004 0.0089 0.0103
-0.0047 -0.0273 -0.0161 0.0043 -0.0069 0.0019 -0.0017 -0.0141 -0.0268 -0.0090 -0.0237 -0.0121 0.0015 -0.0061
-0.0061 -0.0305 -0.0061 -0.0162 -0.0189 -0.0201 -0.0219 -0.0200 -0.0215 -0.0218 -0.0260 -0.0187 -0.0261 -0.0157
-0.0260 -0.0248 -0.0071 -0.0344 -0.0154 -0.0203 -0.0258 -0.0079 -0.0327 -0.0061 -0.0179 -0.0214 -0.0226 -0.0245
-0.0031 -0.0204 -0.0192 -0.0197 -0.0172 -0.0107 0.0022 -0.0028 -0.0052 0.0307 0.0369 0.0385 0.0398 0.0495
0.0704 0.0609 0.0250 0.0061 0.0017 -0.0054 -0.0227 -0.0086 -0.0035 -0.0274 -0.0081 -0.0358 -0.0094 -0.0017
""")
