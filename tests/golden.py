"""The published yearly series in thousand USD and results derived from it."""

# (year, exports, imports)
YEARLY = [
    (1995, 4076645.4302, 3547622.228),
    (1996, 4299088.2775, 5132081.1931),
    (1997, 4903121.482, 5589648.0257),
    (1998, 5128137.127, 5999749.4448),
    (1999, 4605819.409, 4077295.4662),
    (2000, 6506158.3003, 6970841.9518),
    (2001, 6675103.3935, 7417138.6022),
    (2002, 6597594.5023, 6717136.7193),
    (2003, 7932689.5433, 8455930.7287),
    (2004, 10017528.7908, 10268331.1233),
    (2005, 10224848.1896, 11758413.6596),
    (2006, 13705947.387, 14448550.1359),
    (2007, 14509506.8765, 16065879.1845),
    (2008, 16778596.4038, 20685688.5682),
    (2009, 17559037.034, 20358942.9),
    (2010, 20435415.5133, 27572119.7339),
    (2011, 26757742.0302, 37306480.7459),
    (2012, 26994135.1613, 33530165.4152),
    (2013, 30368121.6667, 33971221.2946),
    (2014, 31724265.7493, 36744800.1142),
    (2015, 34854720.9589, 46126423.9775),
    (2016, 35765636.1, 39061761.0936),
    (2017, 37398559.3264, 46110377.8292),
    (2018, 43026686.2257, 52802126.6329),
    (2019, 44963061.3952, 52934016.5134),
    (2020, 39321421.8726, 45380411.7984),
    (2021, 50695184.8497, 72577425.8598),
    (2022, 63135732.3973, 79678908.7306),
    (2023, 51402494.9728, 59753763.4249),
]

# year: (balance, openness)
BALANCE_OPENNESS = {
    1995: (529023.2021999997, 0.1492526182950471),
    1996: (-832992.9156, 0.18462451741938024),
    1997: (-686526.5437000003, 0.20540639342669523),
    1998: (-871612.3177999994, 0.2178394412931139),
    1999: (528523.9427999998, 0.16998060511247007),
    2000: (-464683.6514999997, 0.26382567671605345),
    2001: (-742035.2086999994, 0.2758696454266678),
    2002: (-119542.21700000018, 0.26064909914085826),
    2003: (-523241.1854000008, 0.3208235328947999),
    2004: (-250802.33249999955, 0.39711587293103673),
    2005: (-1533565.4700000007, 0.4303442031091205),
    2006: (-742602.7489, 0.5511522759244679),
    2007: (-1556372.3080000002, 0.5985435755364752),
    2008: (-3907092.1644, 0.7334006196134656),
    2009: (-2799905.8659999967, 0.7422821494890521),
    2010: (-7136704.220599998, 0.9397952242442643),
    2011: (-10548738.715699997, 1.2541208437358997),
    2012: (-6536030.253899999, 1.1848233478271848),
    2013: (-3603099.6279000007, 1.259506594843779),
    2014: (-5020534.364900004, 1.3403500257959249),
    2015: (-11271703.018600002, 1.5852864112514526),
    2016: (-3296124.993599996, 1.4648206820673104),
    2017: (-8711818.502800003, 1.6347704566883516),
    2018: (-9775440.407200001, 1.8759442701187679),
    2019: (-7970955.118200004, 1.9164326144266481),
    2020: (-6058989.925800003, 1.6581225917733524),
    2021: (-21882241.0101, 2.4131838934944563),
    2022: (-16543176.333300002, 2.7957385646451614),
    2023: (-8351268.452100001, 2.175994252758741),
}

# direction: (growth rows, mean %, sample deviation %, interval of the mean)
GROWTH = {
    "export": (28, 10.338878, 14.075874, 4.880824, 15.796932),
    "import": (28, 12.979949, 23.596689, 3.830108, 22.129790),
}

# direction: (slope, intercept, lowest slope, highest slope)
TREND = {
    "export": (1893179.3237, -3785838224.18, 1690266.9033, 2173490.2715),
    "import": (2274288.2950, -4548359496.13, 1983835.3619, 2671831.1705),
}

# direction: (records, skewness, excess kurtosis, Jarque-Bera)
NORMALITY = {
    "export": (48510, 14.505293528630245, 317.03755100688596, 204862627.30653575),
    "import": (79624, 22.890271356839456, 852.5938858432419, 2418619449.8825874),
}
