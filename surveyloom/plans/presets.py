"""Column presets for the public 2022 student survey files, as plain configuration."""

from surveyloom.operators.models import InteractionSpec
from surveyloom.operators.normalize import Dimension, IndexSpec

# Variable codes of the survey's student and school files.
SITE_KEY = "CNTSCHID"
SCORE = "PV1MATH"
WEIGHT = "W_FSTUWT"
GROUP = "CNT"
CONTROL = "ESCS"
RESOURCE_ITEMS = ("HOMEPOS", "WORKHOME")
INTERNET_ITEMS = ("ICTRES", "ICTHOME", "ICTAVHOM")
LEARNING_ITEMS = ("ST127Q01TA", "ST127Q02TA", "ST127Q03TA", "ANXMAT")
SEGMENT_ITEMS = ("ST296Q01JA", "ST062Q01TA", "MATHMOT", "PERSEVAGR")
ATTITUDE_ITEMS = ("MATHMOT", "PERSEVAGR", "GROSAGR", "MATHEFF")
REVERSED_ITEM = "ST062Q01TA"
SCHOOL_SHORTAGE_ITEMS = ("SC017Q01NA", "SC017Q02NA", "SC017Q03NA", "SC017Q05NA")
SCHOOL_LOCATION_ITEM = "SC001Q01TA"
SEGMENT_ITEM_NAMES = {
    "ST296Q01JA": "Learning Time",
    "ST062Q01TA": "School Discipline (inverted)",
    "MATHMOT": "Math Motivation",
    "PERSEVAGR": "Perseverance",
}

STUDENT_COLUMNS = tuple(
    dict.fromkeys(
        (SITE_KEY, SCORE, WEIGHT, GROUP, CONTROL)
        + RESOURCE_ITEMS
        + INTERNET_ITEMS
        + LEARNING_ITEMS
        + SEGMENT_ITEMS
        + ATTITUDE_ITEMS
    )
)
SCHOOL_COLUMNS = (SITE_KEY, *SCHOOL_SHORTAGE_ITEMS, SCHOOL_LOCATION_ITEM)

STUDENT_INDEX = IndexSpec(
    (
        Dimension("dim_means", RESOURCE_ITEMS + SCHOOL_SHORTAGE_ITEMS, 0.25, reverse=True),
        Dimension("dim_connection", INTERNET_ITEMS, 0.25, reverse=True),
        Dimension("dim_study_strain", LEARNING_ITEMS, 0.25),
        Dimension("dim_remoteness", (SCHOOL_LOCATION_ITEM,), 0.25, reverse=True),
    ),
    missing="impute_mean",
    output="need_index",
)

STUDENT_INTERACTION = InteractionSpec(
    score=SCORE,
    index="need_index",
    attitude_items=ATTITUDE_ITEMS,
    group=GROUP,
    weight=WEIGHT,
    control=CONTROL,
    negate=(REVERSED_ITEM,),
)
