"""What is known beforehand of three public datasets: names, on/off rules, meters, houses of the splits.

Everything here is a fixed value: thresholds in watts, durations in steps of 10 seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values ----------------------------------------------------------------------------------

APPLIANCES = {
    "ukdale": ["washing_machine", "cooker", "dishwasher", "kettle", "fridge", "microwave", "electric_heater"],
    "refit": ["WashingMachine", "Dishwasher", "Kettle", "Microwave"],
    "redd": ["Fridge", "Dishwasher", "Microwave", "WashingMachine", "WasherDryer"],
}

#: appliance: (low, high, min_on, min_off, min_activation)
DURATION_RULES = {
    "ukdale": {
        "kettle": (2000, 3100, 1, 0, 1),
        "fridge": (50, 300, 6, 1, 1),
        "washing_machine": (20, 2500, 180, 16, 12),
        "microwave": (200, 3000, 1, 3, 1),
        "dishwasher": (10, 2500, 180, 180, 12),
    },
    "refit": {
        "Kettle": (1000, 6000, 1, 0, 0),
        "WashingMachine": (20, 3500, 6, 16, 12),
        "Dishwasher": (50, 3000, 2, 180, 12),
        "Microwave": (200, 6000, 1, 3, 0),
    },
    "redd": {
        "Fridge": (50, 300, 6, 1, 1),
        "Microwave": (200, 3000, 1, 3, 1),
        "Dishwasher": (10, 2500, 180, 180, 12),
        "WashingMachine": (20, 6000, 30, 16, 12),
        "WasherDryer": (20, 6000, 30, 16, 12),
    },
}

#: appliance: (low, high), for states without durations
PLAIN_RULES = {
    "ukdale": {"kettle": (500, 6000), "washing_machine": (300, 3000), "dishwasher": (300, 3000), "microwave": (200, 6000), "fridge": (50, 300)},
    "refit": {"Kettle": (500, 6000), "WashingMachine": (300, 4000), "Dishwasher": (300, 4000), "Microwave": (200, 6000)},
    "redd": {"Fridge": (50, 300), "Microwave": (200, 3000), "Dishwasher": (10, 2500), "WashingMachine": (20, 6000), "WasherDryer": (20, 6000)},
}

SYNTHETIC = {
    "ukdale": ["fridge", "washing_machine", "kettle", "dishwasher", "microwave"],
    "refit": ["WashingMachine", "Dishwasher", "Kettle", "Microwave"],
    "redd": ["Fridge", "Dishwasher", "Microwave", "WashingMachine"],
}

#: Meters of the mains, and house: appliance: meters.
MAINS = [1, 2]
METERS = {
    1: {"Fridge": [5], "Dishwasher": [6], "Microwave": [11], "WashingMachine": [10, 20], "WasherDryer": [10, 20]},
    2: {"Fridge": [9], "Dishwasher": [10], "Microwave": [6], "WashingMachine": [7], "WasherDryer": [7]},
    3: {"Fridge": [7], "Dishwasher": [9], "Microwave": [16], "WashingMachine": [13, 14], "WasherDryer": [13, 14]},
    4: {"Dishwasher": [15], "WashingMachine": [7], "WasherDryer": [7]},
    5: {"Fridge": [18], "Dishwasher": [20], "Microwave": [3], "WashingMachine": [8, 9], "WasherDryer": [8, 9]},
    6: {"Fridge": [8], "Dishwasher": [9], "WashingMachine": [4], "WasherDryer": [4]},
}

#: dataset: appliance: (train houses, valid houses, test houses)
HOUSE_LISTS = {
    "ukdale": {
        "washing_machine": ([1, 3, 4, 5], [5], [2]),
        "dishwasher": ([1, 3, 4, 5], [1], [2]),
        "kettle": ([1, 3, 4, 5], [1], [2]),
        "microwave": ([1, 3, 4, 5], [1], [2]),
        "fridge": ([1, 3, 4, 5], [1], [2]),
    },
    "redd": {
        "WasherDryer": ([3, 5, 6], [4], [1]),
        "Fridge": ([3, 5, 6], [2], [1]),
        "Dishwasher": ([3, 4, 5, 6], [2], [1]),
        "Microwave": ([3, 5], [2], [1]),
    },
}

#: Houses that have the appliance, to be split by split_houses.
HOUSES_WITH = {
    "Dishwasher": [1, 2, 3, 5, 6, 7, 9, 10, 13, 15, 16, 18, 20],
    "WashingMachine": [1, 2, 3, 5, 6, 7, 8, 9, 10, 13, 15, 16, 17, 18, 19],
    "Kettle": [2, 3, 4, 5, 6, 7, 9, 12, 13, 15, 19, 20],
    "Microwave": [2, 3, 4, 6, 8, 9, 10, 12, 13, 15, 17, 18, 19, 20],
}

# --- as small dimensions ---------------------------------------------------------------------------


def rule_table(spark: SparkSession, dataset: str, durations: bool = True) -> DataFrame:
    """appliance, min_threshold, max_threshold, min_on, min_off, min_activation; without durations, runs of any length stay."""
    rules = DURATION_RULES[dataset] if durations else {a: (*r, 1, 0, 0) for a, r in PLAIN_RULES[dataset].items()}
    return spark.createDataFrame([(a, *r) for a, r in rules.items()], "appliance string, min_threshold int, max_threshold int, min_on int, min_off int, min_activation int")


def meter_table(spark: SparkSession) -> DataFrame:
    """house, appliance, meters."""
    return spark.createDataFrame([(h, a, m) for h, own in METERS.items() for a, m in own.items()], "house int, appliance string, meters array<int>")


def split_table(spark: SparkSession, dataset: str) -> DataFrame:
    """appliance, house, split; a house may be in two splits of an appliance."""
    rows = [(a, h, s) for a, lists in HOUSE_LISTS[dataset].items() for s, houses in zip(("train", "valid", "test"), lists, strict=True) for h in houses]
    return spark.createDataFrame(rows, "appliance string, house int, split string")


def houses_with(spark: SparkSession) -> DataFrame:
    """appliance, house."""
    return spark.createDataFrame([(a, h) for a, houses in HOUSES_WITH.items() for h in houses], "appliance string, house int")
