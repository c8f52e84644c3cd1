"""The toy table of the original job."""

# The toy table of the original job (20 training, 8 test rows).
TOY_TRAIN = [
    (0.0, "3", 1.0, "N"), (0.0, "3", 1.0, "Y"), (0.0, "3", 1.0, "N"), (0.0, "3", 1.0, "N"),
    (0.0, "3", 1.0, "Y"), (0.1, "3", 1.0, "N"), (1.0, "4", 0.0, "N"), (1.0, "4", 0.0, "Y"),
    (1.0, "4", 0.0, "Y"), (1.0, "4", 0.0, "Y"), (2.0, "5", 1.0, "Y"), (1.0, "3", 1.0, "N"),
    (0.1, "3", 1.0, "N"), (3.0, "5", 0.0, "N"), (3.0, "5", 0.8, "N"), (3.0, "5", 0.9, "N"),
    (3.0, "5", 0.9, "Y"), (2.0, "3.4", 0.9, "N"), (3.0, "5", 0.9, "N"), (3.0, "5", 0.0, "Y"),
]
TOY_TEST = [
    (0.0, "3", 1.0, "N"), (0.0, "4", 1.0, "Y"), (0.0, "3", 1.0, "N"), (2.0, "3.4", 0.9, "Y"),
    (1.0, "3", 1.0, "Y"), (0.1, "3", 1.0, "N"), (3.0, "5", 0.0, "N"), (3.0, "5", 0.8, "N"),
]
TOY_SCHEMA = "_1 double, _2 string, _3 double, _4 string"


def toy_tables(spark):
    return (spark.createDataFrame(TOY_TRAIN, TOY_SCHEMA),
            spark.createDataFrame(TOY_TEST, TOY_SCHEMA))
