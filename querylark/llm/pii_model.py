"""Made by pii_training.py: trees over pii.FEATURES, as [feature, threshold, left, right] or a leaf."""

PRIOR = 0.301437
TREES = [
    [11, 0, [8, 0, [10, 0, -0.365571, 0.515317], 0.516794], [1, 8, [0, 0, -0.692828, 0.429447], [5, 2, 0.495146, 0.12531]]],
    [9, 0, [11, 0, [8, 0, -0.264628, 0.427479], [1, 8, -0.427181, 0.385032]], [11, 0, 0.610175, 0.409096]],
    [10, 0, [1, 24, [9, 0, -0.21859, 0.452242], [5, 4, 0.10109, 0.698455]], 0.452232],
    [8, 0, [10, 0, [7, 0, -0.209507, 0.211825], 0.396041], 0.405744],
    [5, 5, [9, 0, [8, 0, -0.107674, 0.368596], 0.418593], [1, 24, 0.838012, 0.531024]],
    [13, 0, [14, 3, [9, 0, -0.097026, 0.375718], 0.385298], [10, 0, 0.926713, 0.360838]],
    [10, 0, [1, 24, [8, 0, -0.177592, 0.350544], [5, 4, 0.08975, 0.532944]], 0.368324],
    [12, 0, [7, 0, [0, 0, -0.39187, 0.039778], [1, 8, -0.380052, 0.376391]], [8, 0, 1.066468, 0.325931]],
    [9, 0, [1, 20, [10, 0, -0.171265, 0.342956], [5, 4, -0.01291, 0.549329]], 0.365866],
    [11, 0, [0, 0, [9, 0, -0.376612, 0.331596], [1, 19, -0.045983, 0.470465]], [1, 8, [0, 0, -0.33952, 0.253043], [7, 0, 0.04571, 0.356185]]],
    [13, 0, [8, 0, [7, 0, -0.134724, 0.196658], 0.335006], [10, 0, 0.650932, 0.302695]],
    [9, 0, [12, 0, [10, 0, -0.090124, 0.331619], [8, 0, 0.675599, 0.305941]], 0.346774],
    [8, 0, [7, 0, [0, 0, -0.309417, 0.00038], [1, 8, -0.327047, 0.333581]], 0.321717],
    [13, 0, [9, 0, [3, 8, -0.149611, 0.126816], 0.332924], [10, 0, 0.490953, 0.277209]],
    [10, 0, [8, 0, [3, 8, -0.150969, 0.091387], 0.315855], 0.32383],
    [12, 0, [9, 0, [7, 0, -0.099301, 0.181946], 0.324653], [8, 0, 0.550359, 0.276109]],
    [13, 0, [8, 0, [5, 5, -0.064259, 0.374844], 0.307941], 0.407761],
    [10, 0, [9, 0, [3, 13, -0.127288, 0.10117], 0.31432], 0.317946],
    [12, 0, [7, 0, [0, 0, -0.304406, 0.032945], [1, 8, -0.300192, 0.319007]], [8, 0, 0.464201, 0.256772]],
    [13, 0, [9, 0, [8, 0, -0.065013, 0.30124], 0.306961], 0.381087],
    [10, 0, [1, 20, [12, 0, -0.117234, 0.371575], [5, 4, -0.081512, 0.418284]], 0.307812],
    [7, 0, [0, 0, [9, 0, -0.333943, 0.274929], [1, 19, -0.046106, 0.387007]], [1, 8, -0.282338, 0.314837]],
    [13, 0, [7, 0, [8, 0, -0.087661, 0.296452], [1, 8, -0.271357, 0.306672]], 0.362487],
    [9, 0, [10, 0, [7, 0, -0.091066, 0.185648], 0.301858], 0.300655],
    [12, 0, [9, 0, [3, 13, -0.095807, 0.108943], 0.290997], 0.3619],
    [13, 0, [8, 0, [10, 0, -0.0673, 0.294631], 0.292624], 0.347519],
    [10, 0, [8, 0, [3, 10, -0.104458, 0.09268], 0.283327], 0.28503],
    [9, 0, [13, 0, [7, 0, -0.075613, 0.17983], 0.327367], 0.287143],
    [12, 0, [5, 5, [9, 0, -0.050023, 0.277474], 0.306564], 0.35527],
    [10, 0, [8, 0, [3, 8, -0.108849, 0.076378], 0.277415], 0.279177],
    [13, 0, [12, 0, [7, 0, -0.066024, 0.162314], 0.331513], 0.31445],
    [0, 0, [7, 0, [9, 0, -0.315817, 0.210248], [1, 8, -0.264261, 0.291492]], [1, 19, [2, 8, -0.263572, 0.085891], 0.368751]],
]
CALIBRATION = (3.095991, 4.153231)
THRESHOLDS = [0.9999, 0.9999, 0.0325]
