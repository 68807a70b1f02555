"""Thresholds and fixed vocabularies of label checking."""

from __future__ import annotations

from dataclasses import dataclass

FIELDS = ("brand_name", "class_type", "alcohol_content", "net_contents", "producer_info", "country_of_origin", "health_warning_text")
REFERENCE_FIELDS = FIELDS[:6]


@dataclass(frozen=True)
class Thresholds:
    text: float = 85.0  # similarity of brand, class, producer and country
    warning: float = 80.0
    fallback: float = 85.0  # of strengths and volumes that don't parse; not configurable upstream
    abv_points: float = 0.3
    volume_percent: float = 1.0
    ocr_confidence: float = 30.0
    image_side: int = 150


# The health warning that a label must carry.
WARNING = (
    "GOVERNMENT WARNING: (1) According to the Surgeon General, women should not "
    "drink alcoholic beverages during pregnancy because of the risk of birth defects. "
    "(2) Consumption of alcoholic beverages impairs your ability to drive a car or "
    "operate machinery, and may cause health problems."
)

# Class and type designations; of equally long ones the earlier wins.
CLASS_TYPES = (
    "bourbon", "scotch", "whiskey", "whisky", "rye", "vodka", "gin", "rum", "tequila", "mezcal", "brandy", "cognac",
    "liqueur", "cordial", "wine", "champagne", "sparkling wine", "cider", "beer", "ale", "lager", "stout", "porter",
    "malt beverage", "vermouth", "sake", "red wine", "white wine", "rosé wine", "rose wine", "blush wine",
    "dessert wine", "fortified wine", "table wine", "kentucky straight bourbon", "straight bourbon", "straight rye",
    "tennessee whiskey", "single malt scotch", "blended whiskey", "irish whiskey", "canadian whisky",
    "london dry gin", "silver tequila", "blanco tequila", "reposado tequila", "reposado", "añejo tequila",
    "anejo tequila", "añejo", "anejo", "spiced rum", "white rum", "dark rum", "armagnac", "cabernet sauvignon",
    "cabernet franc", "sauvignon blanc", "pinot grigio", "pinot gris", "pinot noir", "chenin blanc", "chardonnay",
    "merlot", "riesling", "zinfandel", "malbec", "syrah", "shiraz", "moscato", "viognier", "grenache", "tempranillo",
    "sangiovese", "nebbiolo",
)

# The same by broad category, and the names of the categories; again the earlier of equally long ones wins.
SPIRITS = (
    "bourbon", "scotch", "whiskey", "whisky", "rye", "vodka", "gin", "rum", "tequila", "mezcal", "brandy", "cognac",
    "liqueur", "cordial", "armagnac", "kentucky straight bourbon", "straight bourbon", "straight rye",
    "tennessee whiskey", "single malt scotch", "blended whiskey", "irish whiskey", "canadian whisky",
    "london dry gin", "silver tequila", "blanco tequila", "reposado tequila", "reposado", "añejo tequila",
    "anejo tequila", "añejo", "anejo", "spiced rum", "white rum", "dark rum", "distilled spirits",
)
WINES = (
    "wine", "champagne", "sparkling wine", "cider", "vermouth", "sake", "red wine", "white wine", "rosé wine",
    "rose wine", "blush wine", "dessert wine", "fortified wine", "table wine", "cabernet sauvignon", "cabernet franc",
    "sauvignon blanc", "pinot grigio", "pinot gris", "pinot noir", "chenin blanc", "chardonnay", "merlot", "riesling",
    "zinfandel", "malbec", "syrah", "shiraz", "moscato", "viognier", "grenache", "tempranillo", "sangiovese",
    "nebbiolo",
)
MALTS = (
    "beer", "ale", "lager", "stout", "porter", "malt beverage",
)
CATEGORY = {k: c for own, c in ((SPIRITS, "distilled spirits"), (WINES, "wine"), (MALTS, "malt beverage")) for k in own}
CLASS_KEYWORDS = sorted(CLASS_TYPES, key=lambda k: -len(k))
CATEGORY_KEYWORDS = sorted(CATEGORY, key=lambda k: -len(k))

# Base words that may follow a more specific designation.
CLASS_SUFFIXES = (
    "whiskey", "whisky", "wine", "rum", "gin", "vodka", "tequila", "brandy", "liqueur", "cordial", "beer", "ale",
    "lager", "cider", "mezcal",
)

# Phrases that open the producer's name and address.
PRODUCER_ANCHORS = (
    "PRODUCED BY", "PRODUCED AND BOTTLED BY", "DISTILLED BY", "DISTILLED AND BOTTLED BY", "BOTTLED BY",
    "BOTTLED AND CANNED BY", "CANNED BY", "PACKED BY", "IMPORTED BY", "VINTED BY", "BREWED BY",
)
PRODUCER_VERBS = (
    "PRODUCED", "BOTTLED", "DISTILLED", "IMPORTED", "VINTED", "BREWED", "CANNED", "PACKED",
)

# Words of addresses that don't tell producers apart.
NOISE_WORDS = (
    "street", "st", "avenue", "ave", "road", "rd", "lane", "ln", "drive", "dr", "boulevard", "blvd", "suite", "ste",
    "unit", "floor", "fl", "way", "highway", "hwy", "llc", "inc", "co", "company", "corp", "ltd",
)

# States of the USA and their postal abbreviations.
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO",
    "CONNECTICUT": "CT", "DELAWARE": "DE", "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID",
    "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA",
    "MAINE": "ME", "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS",
    "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ",
    "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH",
    "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC",
    "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA",
    "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY", "DISTRICT OF COLUMBIA": "DC",
}

# Countries that end an address (Georgia is a state and a country).
COUNTRIES = (
    "UNITED STATES OF AMERICA", "UNITED STATES", "USA", "CANADA", "MEXICO", "FRANCE", "ITALY", "SPAIN", "GERMANY",
    "SCOTLAND", "IRELAND", "ENGLAND", "WALES", "UNITED KINGDOM", "AUSTRALIA", "CHILE", "ARGENTINA", "NEW ZEALAND",
    "PORTUGAL", "GREECE", "AUSTRIA", "SOUTH AFRICA", "JAPAN", "BRAZIL", "PERU", "URUGUAY", "CHINA", "INDIA", "POLAND",
    "HUNGARY", "CROATIA", "SLOVENIA", "ROMANIA", "BULGARIA", "GEORGIA", "ISRAEL", "LEBANON", "MOROCCO", "TUNISIA",
    "NETHERLANDS", "BELGIUM", "SWITZERLAND", "SWEDEN", "NORWAY", "DENMARK", "FINLAND", "RUSSIA", "UKRAINE", "TURKEY",
    "SOUTH KOREA", "TAIWAN", "THAILAND", "VIETNAM", "PHILIPPINES", "JAMAICA", "BARBADOS", "CUBA",
    "DOMINICAN REPUBLIC", "GUATEMALA", "COLOMBIA", "VENEZUELA", "ECUADOR", "BOLIVIA", "PARAGUAY", "CZECH REPUBLIC",
    "SLOVAKIA", "SERBIA", "LUXEMBOURG", "MALTA", "CYPRUS", "ICELAND",
)


def spaced(name: str) -> str:
    """A pattern for a name whose words any white space may part."""
    return r"\s+".join(name.split())


STATE_NAMES = "|".join(spaced(s) for s in STATES)
STATE_CODES = "|".join(STATES.values())
COUNTRY_NAMES = r"U\.S\.A\.?|" + "|".join(spaced(c) for c in COUNTRIES)
