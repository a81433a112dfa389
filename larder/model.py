"""Domain tables: schemas, length limits, keys and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_STR, _INT, _DBL, _TS, _BOOL = (
    T.StringType(),
    T.IntegerType(),
    T.DoubleType(),
    T.TimestampType(),
    T.BooleanType(),
)


def _struct(required: dict, optional: dict, order: str) -> T.StructType:
    kinds = {**required, **optional}
    return T.StructType(
        [T.StructField(name, kinds[name], name not in required) for name in order.split()]
    )


PLACES = _struct(
    {"id": _STR, "name": _STR, "city": _STR, "district": _STR, "created_at": _TS, "updated_at": _TS},
    {
        "latitude": _DBL,
        "longitude": _DBL,
        "website": _STR,
        "phone": _STR,
        "description": _STR,
        "rating": _DBL,
        "review_count": _INT,
        "category": _STR,
        "price_level": _STR,
        "opening_hours": _STR,
        "operating_hours": T.MapType(_STR, _STR),
        "google_place_id": _STR,
        "serpapi_data_id": _STR,
        "thumbnail": _STR,
        "reviews_link": _STR,
        "photos_link": _STR,
        "user_review": _STR,
    },
    "id name city district latitude longitude website phone description rating review_count "
    "category price_level opening_hours operating_hours google_place_id serpapi_data_id thumbnail "
    "reviews_link photos_link user_review created_at updated_at",
)

MENU_ITEMS = _struct(
    {
        "id": _STR,
        "restaurant_id": _STR,
        "name": _STR,
        "price": T.DecimalType(10, 2),
        "category": _STR,
        "created_at": _TS,
        "updated_at": _TS,
    },
    {"description": _STR},
    "id restaurant_id name price category description created_at updated_at",
)

USER_REVIEWS = _struct(
    {
        "id": _STR,
        "user_id": _STR,
        "restaurant_id": _STR,
        "rating": _INT,
        "created_at": _TS,
        "updated_at": _TS,
    },
    {"comment": _STR},
    "id user_id restaurant_id rating comment created_at updated_at",
)

EXT_REVIEWS = _struct(
    {
        "id": _STR,
        "restaurant_id": _STR,
        "review_hash": _STR,
        "raw_json": _STR,
        "created_at": _TS,
        "updated_at": _TS,
    },
    {
        "author_name": _STR,
        "rating": _INT,
        "review_text": _STR,
        "review_date": _STR,
        "profile_photo": _STR,
        "likes": _INT,
        "provider_review_id": _STR,
        "language": _STR,
    },
    "id restaurant_id author_name rating review_text review_date profile_photo likes "
    "provider_review_id language review_hash raw_json created_at updated_at",
)

FAVORITES = _struct(
    {"id": _STR, "user_id": _STR, "restaurant_id": _STR, "created_at": _TS},
    {},
    "id user_id restaurant_id created_at",
)

USERS = _struct(
    {
        "id": _STR,
        "username": _STR,
        "email": _STR,
        "hashed_password": _STR,
        "is_active": _BOOL,
        "is_admin": _BOOL,
        "created_at": _TS,
        "updated_at": _TS,
    },
    {},
    "id username email hashed_password is_active is_admin created_at updated_at",
)

TABLES = {
    "places": PLACES,
    "menu_items": MENU_ITEMS,
    "user_reviews": USER_REVIEWS,
    "ext_reviews": EXT_REVIEWS,
    "favorites": FAVORITES,
    "users": USERS,
}

# Longest text per column.
MAX_LENGTH = {
    "places": {
        "name": 255,
        "city": 100,
        "district": 100,
        "website": 255,
        "phone": 50,
        "description": 1000,
        "category": 100,
        "price_level": 20,
        "google_place_id": 255,
        "serpapi_data_id": 255,
        "thumbnail": 500,
        "reviews_link": 500,
        "photos_link": 500,
    },
    "menu_items": {"name": 255, "category": 100, "description": 1000},
    "user_reviews": {"comment": 1000},
    "ext_reviews": {
        "author_name": 255,
        "review_date": 100,
        "profile_photo": 500,
        "provider_review_id": 255,
        "language": 20,
        "review_hash": 64,
    },
    "favorites": {},
    "users": {"username": 50, "email": 255, "hashed_password": 255},
}

# Column groups that must be unique; a NULL in a group makes its row distinct.
UNIQUE = {
    "places": [["id"]],
    "menu_items": [["id"]],
    "user_reviews": [["id"], ["user_id", "restaurant_id"]],
    "ext_reviews": [
        ["id"],
        ["restaurant_id", "provider_review_id"],
        ["restaurant_id", "review_hash"],
    ],
    "favorites": [["id"], ["user_id", "restaurant_id"]],
    "users": [["id"], ["username"], ["email"]],
}

# child table -> [(child column, parent table)]; the parent column is always ``id``.
REFERENCES = {
    "menu_items": [("restaurant_id", "places")],
    "user_reviews": [("restaurant_id", "places"), ("user_id", "users")],
    "ext_reviews": [("restaurant_id", "places")],
    "favorites": [("restaurant_id", "places"), ("user_id", "users")],
}

# Tables whose rows go away with their place.
PLACE_CHILDREN = [child for child, refs in REFERENCES.items() if ("restaurant_id", "places") in refs]

MIN_RATING, MAX_RATING = 1, 5


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring a frame of an older or wider shape to ``schema``.

    Columns that the frame lacks are added as NULL, columns that it already has are kept.
    """
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
