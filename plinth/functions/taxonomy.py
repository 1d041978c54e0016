"""The unified room vocabulary and its lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The unified room labels.
LABELS = ("bedroom", "living_room", "kitchen", "dining", "bathroom", "corridor", "balcony", "storage", "stairwell", "office", "garage", "outdoor", "utility", "room")
DEFAULT = "room"

#: Raw room words of drawings to unified labels; others are `room`.
DRAWING_ROOMS = {
    "Bath": "bathroom", "Bedroom": "bedroom", "CarPort": "garage", "Closet": "storage", "Dining": "dining", "DraughtLobby": "corridor", "DressingRoom": "storage",
    "EatingArea": "dining", "Entry": "corridor", "Garage": "garage", "Hall": "corridor", "HallWay": "corridor", "Kitchen": "kitchen", "LivingRoom": "living_room",
    "Lounge": "living_room", "Office": "office", "Outdoor": "outdoor", "Sauna": "bathroom", "StairWell": "stairwell", "Storage": "storage", "Utility": "utility",
}

#: Room types of scenes to unified labels; others are `room`.
SCENE_ROOMS = {
    "living room": "living_room", "kitchen": "kitchen", "bedroom": "bedroom", "bathroom": "bathroom", "balcony": "balcony", "corridor": "corridor", "dining room": "dining",
    "study": "office", "store room": "storage", "garden": "outdoor", "laundry room": "utility", "office": "office", "garage": "garage",
}

#: Room types of plan configurations to unified labels; others are `room`.
CONFIG_ROOMS = {
    "bedroom": "bedroom", "master_bedroom": "bedroom", "guest_room": "bedroom", "living": "living_room", "open_plan": "living_room", "lounge": "living_room",
    "kitchen": "kitchen", "kitchen_staff": "kitchen", "dining": "dining", "dining_area": "dining", "bathroom": "bathroom", "bathroom_en_suite": "bathroom", "WC": "bathroom",
    "shower": "bathroom", "changing_room": "bathroom", "corridor": "corridor", "hallway": "corridor", "hall": "corridor", "lobby": "corridor", "lift_lobby": "corridor",
    "reception": "corridor", "balcony": "balcony", "garage": "garage", "loading_bay": "garage", "storage": "storage", "store": "storage", "stockroom": "storage",
    "linen_cupboard": "storage", "wardrobe": "storage", "bin_store": "storage", "cycle_store": "storage", "cold_room": "storage", "store_room": "storage", "office": "office",
    "private_office": "office", "meeting_room": "office", "study": "office", "stair": "stairwell", "staircase": "stairwell", "utility": "utility", "service_room": "utility",
    "plant_room": "utility", "sluice": "utility", "workshop": "utility",
}

#: Classes of segmentation rasters: rooms, structure, doors, window.
RASTER_ROOMS = {0: "bedroom", 1: "living_room", 2: "kitchen", 3: "dining", 4: "corridor", 5: "stairwell", 6: "storage", 7: "bathroom", 8: "balcony"}
RASTER_STRUCTURE, RASTER_DOORS, RASTER_WINDOW = 9, (10, 11), 12

VOCABULARIES = {"drawing": DRAWING_ROOMS, "scene": SCENE_ROOMS, "config": CONFIG_ROOMS}

#: The stand-in lookup over the star schema: the first word of a part's type.
PART_WORDS = {"STANDARD": "bedroom", "SMALL": "bathroom", "MEDIUM": "kitchen", "LARGE": "living_room", "ECONOMY": "storage"}


def _lookup(words: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in words.items() for x in pair))


def room_label(raw: Column, vocabulary: str = "config") -> Column:
    """Unified label of a raw room word, `room` where it is unknown or null."""
    return F.coalesce(_lookup(VOCABULARIES[vocabulary])[raw], F.lit(DEFAULT))


def part_label(p_type: Column) -> Column:
    return F.coalesce(_lookup(PART_WORDS)[F.split(p_type, " ")[0]], F.lit(DEFAULT))


def opening_kind(category: Column) -> Column:
    """`window` where the word says so, else `door`."""
    return F.when(F.lower(category).contains("window"), "window").otherwise("door")


ORACLE = """WITH t(word, label) AS (VALUES ('STANDARD', 'bedroom'), ('SMALL', 'bathroom'), ('MEDIUM', 'kitchen'), ('LARGE', 'living_room'), ('ECONOMY', 'storage'))
SELECT coalesce(label, 'room') AS label, count(*) AS n, min(p_partkey) AS first_part FROM part LEFT JOIN t ON split_part(p_type, ' ', 1) = word GROUP BY coalesce(label, 'room')"""
