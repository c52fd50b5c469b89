"""L, M and S of weight, height and BMI for age at every month from 0 to 120, as the reference embeds them."""

KNOT_MONTHS = tuple(range(121))
KNOTS = {
    ("M", "WAZ"): (
        (0.3487, 3.3464, 0.14602), (0.2297, 4.4709, 0.13395), (0.197, 5.5675, 0.12385), (0.1738, 6.3762, 0.11727), (0.1553, 7.0023, 0.11316), (0.1395, 7.5105, 0.10961),
        (0.1257, 7.934, 0.1068), (0.1134, 8.297, 0.10453), (0.1021, 8.6151, 0.10277), (0.0917, 8.9014, 0.10138), (0.0822, 9.1649, 0.10029), (0.0734, 9.4122, 0.09961),
        (0.0651, 9.6479, 0.09917), (0.0573, 9.8749, 0.09897), (0.0498, 10.0953, 0.09884), (0.0427, 10.3108, 0.09885), (0.0358, 10.5228, 0.099), (0.0291, 10.7323, 0.09918),
        (0.0227, 10.9399, 0.09945), (0.0164, 11.1458, 0.09979), (0.0103, 11.3492, 0.10012), (0.0043, 11.5503, 0.1005), (-0.0016, 11.7486, 0.10088), (-0.0074, 11.9441, 0.10126),
        (-0.013, 12.1239, 0.1016), (-0.0183, 12.2996, 0.10191), (-0.0235, 12.4717, 0.10221), (-0.0285, 12.6401, 0.10251), (-0.0333, 12.8048, 0.1028), (-0.0379, 12.966, 0.10309),
        (-0.0424, 13.1234, 0.10338), (-0.0466, 13.2771, 0.10366), (-0.0508, 13.427, 0.10394), (-0.0547, 13.573, 0.1042), (-0.0585, 13.715, 0.10446), (-0.0622, 13.8529, 0.10471),
        (-0.0656, 13.9867, 0.10496), (-0.0679, 14.1664, 0.10517), (-0.0702, 14.3461, 0.10538), (-0.0724, 14.5258, 0.10559), (-0.0747, 14.7055, 0.1058), (-0.077, 14.8852, 0.10601),
        (-0.0793, 15.0649, 0.10621), (-0.0815, 15.2446, 0.10641), (-0.0838, 15.4243, 0.10662), (-0.0861, 15.604, 0.10682), (-0.0883, 15.7837, 0.10703), (-0.0906, 15.9634, 0.10724),
        (-0.0929, 16.1431, 0.10744), (-0.0951, 16.3228, 0.10765), (-0.0974, 16.5025, 0.10786), (-0.0997, 16.6822, 0.10806), (-0.102, 16.8619, 0.10827), (-0.1042, 17.0416, 0.10848),
        (-0.1065, 17.2213, 0.10868), (-0.1088, 17.401, 0.10889), (-0.111, 17.5807, 0.1091), (-0.1133, 17.7604, 0.1093), (-0.1156, 17.9401, 0.10951), (-0.1178, 18.1198, 0.10972),
        (-0.1201, 18.2981, 0.10992), (-0.124, 18.48, 0.11), (-0.127, 18.66, 0.111), (-0.13, 18.84, 0.111), (-0.133, 19.02, 0.112), (-0.136, 19.2, 0.112),
        (-0.139, 19.39, 0.113), (-0.142, 19.57, 0.113), (-0.145, 19.76, 0.114), (-0.148, 19.95, 0.114), (-0.151, 20.14, 0.115), (-0.154, 20.34, 0.115),
        (-0.157, 20.54, 0.116), (-0.16, 20.74, 0.117), (-0.163, 20.94, 0.117), (-0.166, 21.15, 0.118), (-0.169, 21.36, 0.118), (-0.172, 21.57, 0.119),
        (-0.175, 21.78, 0.119), (-0.178, 22.0, 0.12), (-0.181, 22.22, 0.12), (-0.184, 22.44, 0.121), (-0.187, 22.67, 0.121), (-0.19, 22.9, 0.122),
        (-0.193, 23.13, 0.122), (-0.196, 23.36, 0.123), (-0.199, 23.6, 0.123), (-0.202, 23.84, 0.124), (-0.205, 24.08, 0.124), (-0.208, 24.33, 0.125),
        (-0.211, 24.58, 0.125), (-0.214, 24.83, 0.126), (-0.217, 25.08, 0.126), (-0.22, 25.34, 0.127), (-0.223, 25.6, 0.127), (-0.226, 25.86, 0.128),
        (-0.229, 26.13, 0.128), (-0.232, 26.4, 0.129), (-0.235, 26.67, 0.129), (-0.238, 26.95, 0.13), (-0.241, 27.23, 0.13), (-0.244, 27.51, 0.131),
        (-0.247, 27.8, 0.131), (-0.25, 28.09, 0.132), (-0.253, 28.38, 0.132), (-0.256, 28.68, 0.133), (-0.259, 28.98, 0.133), (-0.262, 29.28, 0.134),
        (-0.265, 29.59, 0.134), (-0.268, 29.9, 0.135), (-0.271, 30.22, 0.135), (-0.274, 30.54, 0.136), (-0.277, 30.86, 0.136), (-0.28, 31.19, 0.137),
        (-0.283, 31.52, 0.137), (-0.286, 31.85, 0.138), (-0.289, 32.19, 0.138), (-0.292, 32.53, 0.139), (-0.295, 32.88, 0.139), (-0.298, 33.23, 0.14),
        (-0.301, 33.59, 0.14),
    ),
    ("M", "HAZ"): (
        (1, 49.8842, 0.03795), (1, 54.7244, 0.03557), (1, 58.4249, 0.03424), (1, 61.4292, 0.03328), (1, 63.886, 0.03257), (1, 65.9026, 0.03204),
        (1, 67.6236, 0.03177), (1, 69.1645, 0.0316), (1, 70.5994, 0.03149), (1, 71.9687, 0.03141), (1, 73.2812, 0.03137), (1, 74.5388, 0.03134),
        (1, 75.7096, 0.03133), (1, 76.9003, 0.03134), (1, 78.0486, 0.03137), (1, 79.1699, 0.03141), (1, 80.2587, 0.03147), (1, 81.3162, 0.03154),
        (1, 82.3427, 0.03164), (1, 83.3418, 0.03174), (1, 84.3122, 0.03185), (1, 85.2555, 0.03196), (1, 86.1711, 0.03209), (1, 87.0594, 0.03221),
        (1, 87.1162, 0.0318), (1, 88.0053, 0.03192), (1, 88.8764, 0.03204), (1, 89.7298, 0.03217), (1, 90.5655, 0.03229), (1, 91.3837, 0.03241),
        (1, 92.1843, 0.03254), (1, 92.9673, 0.03266), (1, 93.7328, 0.03278), (1, 94.4808, 0.03291), (1, 95.2114, 0.03303), (1, 95.9246, 0.03315),
        (1, 96.1, 0.0328), (1, 96.8, 0.03282), (1, 97.48, 0.03284), (1, 98.15, 0.03286), (1, 98.81, 0.03288), (1, 99.45, 0.0329),
        (1, 100.08, 0.03292), (1, 100.7, 0.03294), (1, 101.31, 0.03296), (1, 101.9, 0.03299), (1, 102.48, 0.03301), (1, 103.05, 0.03303),
        (1, 103.3, 0.0327), (1, 103.9, 0.03272), (1, 104.49, 0.03274), (1, 105.07, 0.03276), (1, 105.64, 0.03278), (1, 106.2, 0.03281),
        (1, 106.75, 0.03283), (1, 107.29, 0.03285), (1, 107.82, 0.03287), (1, 108.34, 0.0329), (1, 108.85, 0.03292), (1, 109.35, 0.03294),
        (1, 110.0, 0.033), (1, 110.8, 0.0391), (1, 111.3, 0.0392), (1, 111.8, 0.0393), (1, 112.3, 0.0394), (1, 112.8, 0.0395),
        (1, 113.3, 0.0396), (1, 113.8, 0.0397), (1, 114.3, 0.0398), (1, 114.8, 0.0399), (1, 115.4, 0.04), (1, 115.9, 0.0401),
        (1, 116.4, 0.0402), (1, 116.9, 0.0403), (1, 117.4, 0.0404), (1, 117.9, 0.0405), (1, 118.4, 0.0406), (1, 118.9, 0.0407),
        (1, 119.4, 0.0408), (1, 119.9, 0.0409), (1, 120.5, 0.041), (1, 121.0, 0.0411), (1, 121.5, 0.0412), (1, 122.0, 0.0413),
        (1, 122.5, 0.0414), (1, 123.0, 0.0415), (1, 123.5, 0.0416), (1, 124.0, 0.0417), (1, 124.5, 0.0418), (1, 125.0, 0.0419),
        (1, 125.6, 0.042), (1, 126.1, 0.0421), (1, 126.6, 0.0422), (1, 127.1, 0.0423), (1, 127.6, 0.0424), (1, 128.1, 0.0425),
        (1, 128.6, 0.0426), (1, 129.1, 0.0427), (1, 129.6, 0.0428), (1, 130.1, 0.0429), (1, 130.6, 0.043), (1, 131.1, 0.0431),
        (1, 131.6, 0.0432), (1, 132.1, 0.0433), (1, 132.6, 0.0434), (1, 133.1, 0.0435), (1, 133.6, 0.0436), (1, 134.1, 0.0437),
        (1, 134.6, 0.0438), (1, 135.2, 0.0439), (1, 135.7, 0.044), (1, 136.2, 0.0441), (1, 136.7, 0.0442), (1, 137.2, 0.0443),
        (1, 137.7, 0.0444), (1, 138.2, 0.0445), (1, 138.7, 0.0446), (1, 139.2, 0.0447), (1, 139.8, 0.0448), (1, 140.3, 0.0449),
        (1, 140.8, 0.045),
    ),
    ("M", "BAZ"): (
        (-0.0631, 13.4047, 0.09545), (-0.1165, 14.6956, 0.08859), (-0.204, 15.7284, 0.0847), (-0.2819, 16.4005, 0.08218), (-0.3429, 16.7769, 0.08038), (-0.39, 17.0025, 0.08917),
        (-0.5114, 17.3228, 0.09013), (-0.5292, 17.4422, 0.09122), (-0.5459, 17.4802, 0.09246), (-0.5607, 17.4742, 0.09375), (-0.5735, 17.4461, 0.09494), (-0.5849, 17.3977, 0.09607),
        (-0.6148, 17.7067, 0.09556), (-0.6204, 17.5985, 0.09622), (-0.624, 17.4741, 0.09691), (-0.6247, 17.3437, 0.09748), (-0.6254, 17.2181, 0.09807), (-0.6246, 17.0982, 0.09862),
        (-0.6223, 16.9843, 0.09909), (-0.6181, 16.8766, 0.09951), (-0.6132, 16.7753, 0.09986), (-0.6076, 16.6805, 0.10016), (-0.601, 16.5919, 0.1004), (-0.5942, 16.5098, 0.10059),
        (-0.6064, 16.1435, 0.09166), (-0.6109, 16.0838, 0.09169), (-0.6148, 16.0277, 0.09171), (-0.6181, 15.9752, 0.0917), (-0.6206, 15.926, 0.09166), (-0.6228, 15.8798, 0.0916),
        (-0.6247, 15.8362, 0.09148), (-0.6262, 15.7948, 0.09134), (-0.6273, 15.7553, 0.09118), (-0.628, 15.7175, 0.09099), (-0.6285, 15.6813, 0.09076), (-0.6285, 15.6462, 0.09053),
        (-0.6436, 15.5757, 0.08724), (-0.6479, 15.5468, 0.08697), (-0.6519, 15.5184, 0.08669), (-0.6556, 15.4907, 0.08639), (-0.6591, 15.4636, 0.08609), (-0.6623, 15.4371, 0.08578),
        (-0.6652, 15.4111, 0.08545), (-0.668, 15.3857, 0.08512), (-0.6705, 15.3607, 0.08477), (-0.6728, 15.3362, 0.08441), (-0.6748, 15.3122, 0.08404), (-0.6767, 15.2886, 0.08367),
        (-0.8321, 15.3208, 0.08547), (-0.84, 15.31, 0.0853), (-0.847, 15.298, 0.0851), (-0.8535, 15.285, 0.0849), (-0.8595, 15.271, 0.0847), (-0.865, 15.256, 0.0845),
        (-0.87, 15.24, 0.0843), (-0.8745, 15.223, 0.08412), (-0.8787, 15.205, 0.08393), (-0.8826, 15.186, 0.08375), (-0.886, 15.166, 0.08357), (-0.8892, 15.145, 0.0834),
        (-0.9961, 15.2441, 0.08434), (-1.0, 15.15, 0.085), (-1.01, 15.13, 0.085), (-1.02, 15.11, 0.085), (-1.03, 15.09, 0.085), (-1.04, 15.07, 0.085),
        (-1.05, 15.05, 0.085), (-1.06, 15.04, 0.086), (-1.07, 15.03, 0.086), (-1.08, 15.02, 0.086), (-1.09, 15.01, 0.086), (-1.1, 15.01, 0.086),
        (-1.11, 15.0, 0.086), (-1.12, 15.0, 0.087), (-1.13, 15.0, 0.087), (-1.14, 15.0, 0.087), (-1.15, 15.01, 0.087), (-1.16, 15.01, 0.087),
        (-1.17, 15.02, 0.088), (-1.18, 15.03, 0.088), (-1.19, 15.04, 0.088), (-1.2, 15.05, 0.088), (-1.21, 15.06, 0.089), (-1.22, 15.07, 0.089),
        (-1.23, 15.09, 0.089), (-1.24, 15.1, 0.089), (-1.25, 15.12, 0.09), (-1.26, 15.14, 0.09), (-1.27, 15.16, 0.09), (-1.28, 15.18, 0.091),
        (-1.29, 15.2, 0.091), (-1.3, 15.23, 0.091), (-1.31, 15.25, 0.092), (-1.32, 15.28, 0.092), (-1.33, 15.31, 0.092), (-1.34, 15.34, 0.093),
        (-1.35, 15.37, 0.093), (-1.36, 15.4, 0.093), (-1.37, 15.43, 0.094), (-1.38, 15.47, 0.094), (-1.39, 15.5, 0.094), (-1.4, 15.54, 0.095),
        (-1.41, 15.58, 0.095), (-1.42, 15.62, 0.096), (-1.43, 15.66, 0.096), (-1.44, 15.7, 0.096), (-1.45, 15.74, 0.097), (-1.46, 15.79, 0.097),
        (-1.47, 15.83, 0.098), (-1.48, 15.88, 0.098), (-1.49, 15.93, 0.098), (-1.5, 15.98, 0.099), (-1.51, 16.03, 0.099), (-1.52, 16.08, 0.1),
        (-1.53, 16.13, 0.1), (-1.54, 16.19, 0.101), (-1.55, 16.24, 0.101), (-1.56, 16.3, 0.101), (-1.57, 16.36, 0.102), (-1.58, 16.42, 0.102),
        (-1.59, 16.48, 0.103),
    ),
    ("F", "WAZ"): (
        (0.3809, 3.2322, 0.14171), (0.1714, 4.1873, 0.13724), (0.1706, 5.1282, 0.12741), (0.1516, 5.8527, 0.12024), (0.1366, 6.4235, 0.11582), (0.124, 6.8986, 0.11127),
        (0.1128, 7.297, 0.1082), (0.1025, 7.6497, 0.10584), (0.093, 7.9555, 0.10364), (0.0843, 8.22, 0.10182), (0.0763, 8.4505, 0.10029), (0.0688, 8.6537, 0.09907),
        (0.0619, 8.8494, 0.09813), (0.0555, 9.0391, 0.09749), (0.0494, 9.2238, 0.09712), (0.0437, 9.4041, 0.097), (0.0382, 9.5806, 0.09706), (0.033, 9.7535, 0.09722),
        (0.028, 9.9231, 0.0975), (0.0232, 10.0897, 0.09784), (0.0187, 10.2533, 0.09824), (0.0143, 10.414, 0.09864), (0.0101, 10.5718, 0.09906), (0.0061, 10.7267, 0.09948),
        (0.0023, 10.8785, 0.09987), (-0.0014, 11.0277, 0.10024), (-0.0049, 11.1742, 0.1006), (-0.0083, 11.3182, 0.10094), (-0.0115, 11.4596, 0.10126), (-0.0146, 11.5984, 0.10158),
        (-0.0176, 11.7348, 0.10189), (-0.0205, 11.8686, 0.10218), (-0.0232, 12.0, 0.10246), (-0.0259, 12.1289, 0.10273), (-0.0285, 12.2554, 0.10299), (-0.0309, 12.3796, 0.10325),
        (-0.0333, 12.5015, 0.10349), (-0.0356, 12.6683, 0.10369), (-0.0378, 12.8351, 0.10388), (-0.0399, 13.0019, 0.10408), (-0.0419, 13.1687, 0.10427), (-0.0439, 13.3355, 0.10447),
        (-0.0458, 13.5023, 0.10467), (-0.0477, 13.6691, 0.10486), (-0.0495, 13.8359, 0.10506), (-0.0513, 14.0027, 0.10526), (-0.0531, 14.1695, 0.10545), (-0.0548, 14.3363, 0.10565),
        (-0.0564, 14.5031, 0.10585), (-0.058, 14.6699, 0.10604), (-0.0596, 14.8367, 0.10624), (-0.0611, 15.0035, 0.10644), (-0.0626, 15.1703, 0.10663), (-0.0641, 15.3371, 0.10683),
        (-0.0655, 15.5039, 0.10703), (-0.0669, 15.6707, 0.10722), (-0.0683, 15.8375, 0.10742), (-0.0697, 16.0043, 0.10762), (-0.071, 16.1711, 0.10781), (-0.0723, 16.3379, 0.10801),
        (-0.0736, 16.5047, 0.10821), (-0.076, 17.53, 0.109), (-0.079, 17.7, 0.11), (-0.082, 17.87, 0.11), (-0.085, 18.04, 0.111), (-0.088, 18.22, 0.111),
        (-0.091, 18.4, 0.112), (-0.094, 18.58, 0.112), (-0.097, 18.76, 0.113), (-0.1, 18.95, 0.113), (-0.103, 19.14, 0.114), (-0.106, 19.33, 0.114),
        (-0.109, 19.52, 0.115), (-0.112, 19.72, 0.116), (-0.115, 19.92, 0.116), (-0.118, 20.12, 0.117), (-0.121, 20.33, 0.117), (-0.124, 20.54, 0.118),
        (-0.127, 20.76, 0.118), (-0.13, 20.97, 0.119), (-0.133, 21.2, 0.119), (-0.136, 21.42, 0.12), (-0.139, 21.65, 0.12), (-0.142, 21.89, 0.121),
        (-0.145, 22.13, 0.121), (-0.148, 22.37, 0.122), (-0.151, 22.61, 0.122), (-0.154, 22.86, 0.123), (-0.157, 23.12, 0.123), (-0.16, 23.38, 0.124),
        (-0.163, 23.64, 0.124), (-0.166, 23.91, 0.125), (-0.169, 24.18, 0.125), (-0.172, 24.46, 0.126), (-0.175, 24.74, 0.126), (-0.178, 25.03, 0.127),
        (-0.181, 25.32, 0.127), (-0.184, 25.62, 0.128), (-0.187, 25.92, 0.128), (-0.19, 26.22, 0.129), (-0.193, 26.53, 0.129), (-0.196, 26.85, 0.13),
        (-0.199, 27.17, 0.13), (-0.202, 27.49, 0.131), (-0.205, 27.82, 0.131), (-0.208, 28.16, 0.132), (-0.211, 28.5, 0.132), (-0.214, 28.84, 0.133),
        (-0.217, 29.19, 0.133), (-0.22, 29.55, 0.134), (-0.223, 29.91, 0.134), (-0.226, 30.28, 0.135), (-0.229, 30.65, 0.135), (-0.232, 31.03, 0.136),
        (-0.235, 31.41, 0.136), (-0.238, 31.8, 0.137), (-0.241, 32.19, 0.137), (-0.244, 32.59, 0.138), (-0.247, 33.0, 0.138), (-0.25, 33.41, 0.139),
        (-0.253, 33.83, 0.139),
    ),
    ("F", "HAZ"): (
        (1, 49.1477, 0.0379), (1, 53.6872, 0.03568), (1, 57.0673, 0.0343), (1, 59.8029, 0.03375), (1, 62.0899, 0.03304), (1, 63.9507, 0.03256),
        (1, 65.7311, 0.0323), (1, 67.2873, 0.03213), (1, 68.7498, 0.03202), (1, 70.1435, 0.03193), (1, 71.4818, 0.03189), (1, 72.771, 0.03186),
        (1, 74.015, 0.03184), (1, 75.2176, 0.03185), (1, 76.3817, 0.03189), (1, 77.5099, 0.03194), (1, 78.6029, 0.032), (1, 79.6621, 0.03208),
        (1, 80.6882, 0.03217), (1, 81.6828, 0.03227), (1, 82.6462, 0.03238), (1, 83.5793, 0.03249), (1, 84.4823, 0.03261), (1, 85.3562, 0.03273),
        (1, 85.7153, 0.03247), (1, 86.5694, 0.03259), (1, 87.4068, 0.03271), (1, 88.2279, 0.03283), (1, 89.0332, 0.03295), (1, 89.8229, 0.03308),
        (1, 90.5973, 0.0332), (1, 91.3566, 0.03332), (1, 92.101, 0.03345), (1, 92.8305, 0.03357), (1, 93.5453, 0.03369), (1, 94.2455, 0.03382),
        (1, 94.13, 0.0335), (1, 94.81, 0.03352), (1, 95.49, 0.03354), (1, 96.15, 0.03356), (1, 96.81, 0.03358), (1, 97.45, 0.0336),
        (1, 98.08, 0.03362), (1, 98.7, 0.03364), (1, 99.31, 0.03366), (1, 99.91, 0.03369), (1, 100.49, 0.03371), (1, 101.07, 0.03373),
        (1, 101.3, 0.0334), (1, 101.87, 0.03342), (1, 102.43, 0.03344), (1, 102.98, 0.03346), (1, 103.51, 0.03348), (1, 104.04, 0.0335),
        (1, 104.55, 0.03352), (1, 105.06, 0.03355), (1, 105.55, 0.03357), (1, 106.04, 0.03359), (1, 106.52, 0.03361), (1, 106.99, 0.03363),
        (1, 107.97, 0.0337), (1, 109.8, 0.0404), (1, 110.3, 0.0405), (1, 110.8, 0.0406), (1, 111.3, 0.0407), (1, 111.8, 0.0408),
        (1, 112.3, 0.0409), (1, 112.8, 0.041), (1, 113.3, 0.0411), (1, 113.8, 0.0412), (1, 114.4, 0.0413), (1, 114.9, 0.0414),
        (1, 115.4, 0.0415), (1, 115.9, 0.0416), (1, 116.4, 0.0417), (1, 116.9, 0.0418), (1, 117.5, 0.0419), (1, 118.0, 0.042),
        (1, 118.5, 0.0421), (1, 119.0, 0.0422), (1, 119.6, 0.0423), (1, 120.1, 0.0424), (1, 120.6, 0.0425), (1, 121.2, 0.0426),
        (1, 121.7, 0.0427), (1, 122.2, 0.0428), (1, 122.8, 0.0429), (1, 123.3, 0.043), (1, 123.8, 0.0431), (1, 124.4, 0.0432),
        (1, 124.9, 0.0433), (1, 125.5, 0.0434), (1, 126.0, 0.0435), (1, 126.6, 0.0436), (1, 127.1, 0.0437), (1, 127.7, 0.0438),
        (1, 128.2, 0.0439), (1, 128.8, 0.044), (1, 129.3, 0.0441), (1, 129.9, 0.0442), (1, 130.5, 0.0443), (1, 131.0, 0.0444),
        (1, 131.6, 0.0445), (1, 132.2, 0.0446), (1, 132.7, 0.0447), (1, 133.3, 0.0448), (1, 133.9, 0.0449), (1, 134.4, 0.045),
        (1, 135.0, 0.0451), (1, 135.6, 0.0452), (1, 136.2, 0.0453), (1, 136.8, 0.0454), (1, 137.4, 0.0455), (1, 137.9, 0.0456),
        (1, 138.5, 0.0457), (1, 139.1, 0.0458), (1, 139.7, 0.0459), (1, 140.3, 0.046), (1, 140.9, 0.0461), (1, 141.5, 0.0462),
        (1, 142.1, 0.0463),
    ),
    ("F", "BAZ"): (
        (-0.0631, 13.1567, 0.0943), (-0.1165, 14.2723, 0.08839), (-0.204, 15.167, 0.08371), (-0.2819, 15.7686, 0.08146), (-0.3429, 16.0987, 0.07972), (-0.39, 16.2487, 0.08071),
        (-0.4872, 16.8866, 0.09148), (-0.5023, 17.0116, 0.09266), (-0.5147, 17.0721, 0.09389), (-0.5253, 17.0938, 0.09503), (-0.5339, 17.0857, 0.09604), (-0.5403, 17.0513, 0.09697),
        (-0.584, 17.0893, 0.09694), (-0.5883, 17.0155, 0.09775), (-0.5904, 16.9259, 0.09853), (-0.592, 16.8303, 0.09921), (-0.5921, 16.7311, 0.09984), (-0.5919, 16.6294, 0.1004),
        (-0.5909, 16.526, 0.10087), (-0.5892, 16.4213, 0.10127), (-0.5871, 16.3158, 0.10159), (-0.5844, 16.2098, 0.10185), (-0.5812, 16.1037, 0.10204), (-0.5778, 15.9975, 0.10216),
        (-0.5712, 15.7688, 0.09261), (-0.5725, 15.7052, 0.09257), (-0.5735, 15.6444, 0.0925), (-0.5744, 15.5864, 0.09241), (-0.575, 15.531, 0.09229), (-0.5752, 15.478, 0.09216),
        (-0.5753, 15.4273, 0.092), (-0.5752, 15.3787, 0.09182), (-0.5748, 15.332, 0.09163), (-0.5742, 15.287, 0.09141), (-0.5734, 15.2435, 0.09117), (-0.5724, 15.2013, 0.09092),
        (-0.5887, 15.2988, 0.09032), (-0.5918, 15.2724, 0.09005), (-0.5947, 15.2468, 0.08977), (-0.5973, 15.2218, 0.08948), (-0.5997, 15.1972, 0.08917), (-0.6019, 15.173, 0.08885),
        (-0.6039, 15.1491, 0.08853), (-0.6057, 15.1255, 0.08819), (-0.6073, 15.1022, 0.08784), (-0.6086, 15.0792, 0.08749), (-0.6098, 15.0564, 0.08712), (-0.6108, 15.0338, 0.08675),
        (-0.7521, 15.1413, 0.08851), (-0.76, 15.125, 0.08832), (-0.7676, 15.108, 0.08812), (-0.7748, 15.0905, 0.08792), (-0.7816, 15.0723, 0.08771), (-0.7882, 15.0535, 0.0875),
        (-0.7944, 15.0341, 0.08728), (-0.8002, 15.0141, 0.08707), (-0.8058, 14.9935, 0.08685), (-0.8111, 14.9723, 0.08663), (-0.8161, 14.9506, 0.08641), (-0.8209, 14.9283, 0.08619),
        (-0.9276, 15.1697, 0.0877), (-0.93, 15.17, 0.088), (-0.94, 15.15, 0.088), (-0.95, 15.13, 0.088), (-0.96, 15.12, 0.088), (-0.97, 15.1, 0.088),
        (-0.98, 15.09, 0.089), (-0.99, 15.08, 0.089), (-1.0, 15.07, 0.089), (-1.01, 15.06, 0.089), (-1.02, 15.05, 0.089), (-1.03, 15.05, 0.09),
        (-1.04, 15.05, 0.09), (-1.05, 15.05, 0.09), (-1.06, 15.05, 0.09), (-1.07, 15.06, 0.091), (-1.08, 15.06, 0.091), (-1.09, 15.07, 0.091),
        (-1.1, 15.08, 0.091), (-1.11, 15.1, 0.092), (-1.12, 15.11, 0.092), (-1.13, 15.13, 0.092), (-1.14, 15.15, 0.093), (-1.15, 15.17, 0.093),
        (-1.16, 15.19, 0.093), (-1.17, 15.21, 0.094), (-1.18, 15.24, 0.094), (-1.19, 15.27, 0.094), (-1.2, 15.3, 0.095), (-1.21, 15.33, 0.095),
        (-1.22, 15.36, 0.095), (-1.23, 15.4, 0.096), (-1.24, 15.43, 0.096), (-1.25, 15.47, 0.097), (-1.26, 15.51, 0.097), (-1.27, 15.55, 0.097),
        (-1.28, 15.6, 0.098), (-1.29, 15.64, 0.098), (-1.3, 15.69, 0.099), (-1.31, 15.74, 0.099), (-1.32, 15.79, 0.1), (-1.33, 15.84, 0.1),
        (-1.34, 15.9, 0.1), (-1.35, 15.95, 0.101), (-1.36, 16.01, 0.101), (-1.37, 16.07, 0.102), (-1.38, 16.13, 0.102), (-1.39, 16.2, 0.103),
        (-1.4, 16.26, 0.103), (-1.41, 16.33, 0.104), (-1.42, 16.4, 0.104), (-1.43, 16.47, 0.105), (-1.44, 16.54, 0.105), (-1.45, 16.61, 0.106),
        (-1.46, 16.69, 0.106), (-1.47, 16.77, 0.107), (-1.48, 16.85, 0.107), (-1.49, 16.93, 0.108), (-1.5, 17.01, 0.108), (-1.51, 17.1, 0.109),
        (-1.52, 17.18, 0.109),
    ),
}
