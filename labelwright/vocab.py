"""Fixed values of the domain: outcomes, fields, units, messages and the statement to be checked."""

from __future__ import annotations

OUTCOMES = ("match", "needs_review", "mismatch", "not_compared", "present", "artwork_derived", "not_certified")
#: Rank of outcomes when a row is rolled up to its worst; a match outranks presence.
ROLL_UP = ("error", "mismatch", "not_certified", "needs_review", "not_compared", "artwork_derived", "match", "present")
FIELDS = ("brand_name", "class_type", "alcohol_content", "net_contents", "government_warning")
UNITS = {
    "mL": ("ml", "mls", "milliliter", "milliliters", "millilitre", "millilitres"),
    "L": ("l", "liter", "liters", "litre", "litres"),
    "cL": ("cl", "centiliter", "centiliters", "centilitre", "centilitres"),
    "fl oz": ("floz", "fluidounce", "fluidounces", "oz"),
    "pint": ("pint", "pints", "pt"),
    "quart": ("quart", "quarts", "qt"),
    "gallon": ("gallon", "gallons", "gal"),
}
#: First parts of unit names that print may set apart from the rest.
UNIT_PARTS = ("fluid", "fl", "milli", "centi")
ALCOHOL_WORDS = ("alcohol", "alc", "abv", "volume", "vol", "proof")
COMPARED = FIELDS[:4]
STATEMENT_PREFIX = "GOVERNMENT WARNING:"
STATEMENT_BODY = (
    "(1) According to the Surgeon General, women should not drink alcoholic beverages during pregnancy because of the "
    "risk of birth defects. (2) Consumption of alcoholic beverages impairs your ability to drive a car or operate "
    "machinery, and may cause health problems."
)
#: What the captions of the product types begin with, and the place of their boxes in caption heights.
OPTION_STEMS = {"wine": ("wine",), "distilled spirits": ("distilled", "spirits"), "malt beverage": ("malt", "beverage")}
BOX_SIZE, BOX_GAP = 2.4, 0.25
