"""Labels, identifiers, places, dates and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emipanel.functions.core import as_col
from emipanel.functions.numeric import parse_number

# Building categories and the raw labels that belong to each (compared in lower case).
# "Other - Lodging/Residential" is listed twice by the sources; the later entry, Hotel, holds.
CATEGORY_LABELS = {
    "Office": ["Office", "Bank Branch", "OFFICE BUILDING", "OFFICE 3-9 STORY", "OFFICE 10+ STORY"],
    "Multifamily Housing": ["Multifamily Housing", "Multifamily", "Residential", "Mixed Residential",
                            "APT 31-99 UNITS", "APT 100+ UNITS", "CONDO MAIN"],
    "Mixed Use": ["RES/COMMERCIAL USE", "Mixed Use Property"],
    "Retail": ["Retail Store", "Enclosed Mall", "Strip Mall", "Lifestyle Center"],
    "Commercial (Mixed)": ["Commercial", "Commercial - Port Facility"],
    "Hotel": ["Hotel", "Other - Lodging/Residential"],
    "K-12 School": ["K-12 School", "Pre-school/Daycare"],
    "College/University": ["College/University"],
    "Hospital/Medical": ["Medical Office", "Hospital (General Medical & Surgical)",
                         "Urgent Care/Clinic/Other Outpatient", "Outpatient Rehabilitation/Physical Therapy",
                         "Ambulatory Surgical Center", "Other - Specialty Hospital"],
    "Warehouse/Distribution": ["Non-Refrigerated Warehouse", "Refrigerated Warehouse", "Distribution Center",
                               "WAREHOUSE"],
    "Industrial": ["Manufacturing/Industrial Plant", "Data Center"],
    "Worship": ["Worship Facility"],
    "Senior Living": ["Senior Living Community", "Senior Care Community"],
    "Supermarket/Grocery": ["Supermarket/Grocery Store", "Convenience Store with Gas Station",
                            "Convenience Store without Gas Station", "Food Sales", "Wholesale Club/Supercenter"],
    "Restaurant": ["Restaurant", "Fast Food Restaurant", "Food Service"],
    "Parking": ["Parking"],
    "Laboratory": ["Laboratory"],
    "Fitness Center": ["Fitness Center/Health Club/Gym"],
    "Library": ["Library"],
    "Residence Hall": ["Residence Hall/Dormitory"],
    "Self-Storage": ["Self-Storage Facility"],
    "Other": ["Other", "Other - Recreation", "Other - Entertainment/Public Assembly", "Other - Education",
              "Other - Public Services", "Other - Services", "Other - Technology/Science", "Other - Utility",
              "Zoo", "Museum", "Aquarium", "Performing Arts", "Convention Center", "Movie Theater",
              "Bowling Alley", "Ice/Curling Rink", "Roller Rink", "Swimming Pool", "Social/Meeting Hall",
              "Fire Station", "Police Station", "Prison/Incarceration", "Courthouse",
              "Mailing Center/Post Office", "Transportation Terminal/Station", "Automobile Dealership",
              "Personal Services (Health/Beauty, Dry Cleaning, etc)",
              "Repair Services (Vehicle, Shoe, Locksmith, etc)", "Veterinary Office", "Adult Education",
              "Vocational School/Adult Education", "Bar/Nightclub", "OTHER EXEMPT BLDG"],
}

# The first rule one of whose words occurs in the label decides.
# A word written "^word" must start the label, "=word" must be the whole label.
CATEGORY_RULES = [
    ("Office", ["office"]),
    ("Multifamily Housing", ["multifamily", "apartment", "apt ", "residential"]),
    ("Hotel", ["hotel", "motel"]),
    ("K-12 School", ["school", "k-12"]),
    ("College/University", ["college", "university"]),
    ("Hospital/Medical", ["hospital", "medical", "clinic"]),
    ("Warehouse/Distribution", ["warehouse", "distribution"]),
    ("Retail", ["retail", "store", "mall"]),
    ("Commercial (Mixed)", ["^commercial "]),
    ("Worship", ["worship", "church", "synagogue", "mosque"]),
    ("Senior Living", ["senior", "nursing"]),
    ("Parking", ["parking", "garage"]),
    ("Restaurant", ["restaurant", "food service"]),
    ("Supermarket/Grocery", ["supermarket", "grocery"]),
    ("Industrial", ["manufacturing", "industrial"]),
    ("Laboratory", ["laboratory", "=lab"]),
    ("Library", ["library"]),
    ("Fitness Center", ["fitness", "gym"]),
    ("Mixed Use", ["mixed"]),
    ("Self-Storage", ["self-storage", "storage"]),
    ("Residence Hall", ["dormitor", "residence hall"]),
    ("Multifamily Housing", ["condo"]),
]


def _word_test(label: Column, word: str) -> Column:
    if word[0] == "^":
        return label.startswith(word[1:])
    if word[0] == "=":
        return label == word[1:]
    return label.contains(word)


def _strip(c) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def map_category(c, labels: dict | None = None, rules: list | None = None, default: str = "Other") -> Column:
    """Raw label to category: known label, else first matching word rule, else ``default``; null stays null."""
    def category_of(label):
        out = None
        for category, known in (labels or CATEGORY_LABELS).items():
            test = label.isin([k.lower() for k in known])
            out = F.when(test, category) if out is None else out.when(test, category)
        for category, words in (CATEGORY_RULES if rules is None else rules):
            test = _word_test(label, words[0])
            for w in words[1:]:
                test = test | _word_test(label, w)
            out = out.when(test, category)
        return out.otherwise(default)

    # one cell, so that the label is stripped once and not for every test
    cell = F.transform(F.array(F.lower(_strip(as_col(c)))), category_of)
    return F.when(as_col(c).isNotNull(), F.get(cell, F.lit(0)))


def clean_token(c, joiner: str = "_") -> Column:
    """Lower case; slashes, dashes and runs of blanks become one joiner; null becomes ''."""
    spaced = F.regexp_replace(F.lower(F.coalesce(as_col(c), F.lit(""))), r"[/\-\s]+", " ")
    return F.regexp_replace(F.trim(spaced), " ", joiner)


def slug(c) -> Column:
    return F.regexp_replace(F.lower(_strip(as_col(c))), "[^a-z0-9]+", "_")


def clean_text(c) -> Column:
    return F.regexp_replace(_strip(F.coalesce(as_col(c), F.lit(""))), r"\s+", " ")


def norm_name(c) -> Column:
    return F.lower(_strip(as_col(c)))


def make_id(prefix: str, c) -> Column:
    return F.concat(F.lit(prefix), _strip(as_col(c).cast("string")))


def upper_id(prefix: str, c) -> Column:
    """Identifier from a name: upper case, blanks to underscores."""
    return F.concat(F.lit(prefix), F.replace(F.upper(_strip(as_col(c))), F.lit(" "), F.lit("_")))


def coalesce_id(geo, street, prefix: str = "aus_") -> Column:
    geo = _strip(as_col(geo).cast("string"))
    usable = geo.isNotNull() & (geo != "") & (F.lower(geo) != "nan")
    return F.concat(F.lit(prefix), F.when(usable, geo).otherwise(slug(street)))


# Localities that count as part of a metropolitan area, narrow sets.
METRO_LOCALITIES = {
    "melbourne": ["melbourne", "docklands", "southbank", "south melbourne", "west melbourne", "east melbourne",
                  "north melbourne", "port melbourne", "south wharf", "carlton", "carlton south"],
    "sydney": ["sydney", "north sydney", "parramatta", "st leonards", "north ryde", "macquarie park",
               "surry hills", "barangaroo", "pyrmont", "chatswood"],
    "brisbane": ["brisbane", "brisbane city", "south brisbane", "milton", "newstead", "fortitude valley",
                 "spring hill", "kangaroo point"],
    "perth": ["perth", "west perth", "east perth"],
    "adelaide": ["adelaide", "north adelaide"],
    "canberra": ["canberra", "city", "civic", "barton", "braddon"],
    "hobart": ["hobart"],
    "darwin": ["darwin"],
}

# The wider sets used when regions are merged (underscored tokens).
WIDE_METRO_LOCALITIES = {
    "melbourne": ["melbourne", "docklands", "southbank", "south_melbourne", "west_melbourne", "east_melbourne",
                  "north_melbourne", "port_melbourne", "south_wharf", "carlton", "carlton_south", "abbotsford",
                  "box_hill", "richmond", "hawthorn", "burnley", "burwood", "camberwell", "mount_waverley",
                  "burwood_east", "dandenong", "footscray", "mulgrave", "notting_hill", "melbourne_airport"],
    "sydney": ["sydney", "north_sydney", "parramatta", "st_leonards", "north_ryde", "macquarie_park",
               "surry_hills", "barangaroo", "pyrmont", "chatswood", "rhodes", "haymarket", "cremorne", "mascot",
               "alexandria", "eveleigh", "ultimo", "millers_point", "greenwich", "frenchs_forest", "the_rocks",
               "sydney_olympic_park", "sydney_city", "hurstville", "liverpool"],
    "brisbane": ["brisbane", "brisbane_city", "south_brisbane", "milton", "newstead", "fortitude_valley",
                 "spring_hill", "kangaroo_point", "eight_mile_plains", "bowen_hills", "upper_mount_gravatt",
                 "toowong", "cannon_hill", "hamilton", "port_of_brisbane", "brisbane_airport", "ipswich"],
    "perth": ["perth", "west_perth", "east_perth", "osborne_park", "subiaco", "north_perth", "south_perth",
              "perth_airport"],
    "adelaide": ["adelaide", "north_adelaide", "port_adelaide", "adelaide_city", "mawson_lakes"],
    "canberra": ["canberra", "city", "civic", "barton", "braddon", "phillip", "forrest", "majura", "belconnen",
                 "greenway", "canberra_airport"],
    "gold_coast": ["southport", "bundall", "robina", "varsity_lakes"],
    "hobart": ["hobart"],
    "darwin": ["darwin", "darwin_city"],
    "townsville": ["townsville", "townsville_city"],
    "cairns": ["cairns", "cairns_city"],
    "newcastle": ["newcastle"],
    "wollongong": ["wollongong"],
    "geelong": ["geelong"],
    "port_macquarie": ["port_macquarie"],
}

# The capital that stands for a state.
STATE_CAPITALS = {"VIC": "melbourne", "NSW": "sydney", "QLD": "brisbane", "WA": "perth", "SA": "adelaide",
                  "ACT": "canberra", "TAS": "hobart", "NT": "darwin"}
UNKNOWN_PLACE = "australia_unknown"


def _first_in(value: Column, sets: dict, extra=None) -> Column:
    out = F.lit(None).cast("string")
    for name, members in reversed(list(sets.items())):
        test = value.isin(members)
        if extra and name in extra:
            test = extra[name](test)
        out = F.when(test, name).otherwise(out)
    return out


def _capital(state: Column) -> Column:
    return _first_in(state, {city: [st] for st, city in STATE_CAPITALS.items()})


def normalize_city(suburb, state, address=None) -> Column:
    """Metro name for its known localities, else the locality itself, else the state capital."""
    place = clean_token(suburb, joiner=" ")
    code = F.upper(F.trim(F.coalesce(as_col(state), F.lit(""))))
    extra = {"canberra": lambda t: t & (code == "ACT")}
    if address is not None:
        street = F.concat(F.lit(" "), F.lower(F.trim(F.coalesce(as_col(address), F.lit("")))))
        extra["melbourne"] = lambda t: t | (street.contains(" vic") & (place == "city"))
    return F.coalesce(_first_in(place, METRO_LOCALITIES, extra),
                      F.nullif(F.replace(place, F.lit(" "), F.lit("_")), F.lit("")),
                      _capital(code), F.lit(UNKNOWN_PLACE))


def normalize_metro(suburb, state) -> Column:
    """Wider sets; here the state capital comes before the bare locality."""
    place = clean_token(suburb)
    code = F.upper(F.trim(F.coalesce(as_col(state), F.lit(""))))
    return F.coalesce(_first_in(place, WIDE_METRO_LOCALITIES), _capital(code),
                      F.nullif(place, F.lit("")), F.lit(UNKNOWN_PLACE))


def year_of(c, formats: list[str], fallback=None) -> Column:
    """Year of a date text in the first format that fits, else the fallback (e.g. the file's year)."""
    c = as_col(c)
    options = [F.year(F.try_to_timestamp(c, F.lit(f))) for f in formats]
    if fallback is not None:
        options.append(as_col(fallback))
    return F.coalesce(*options)


def build_query(parts, zip_code=None) -> Column:
    """Address line: non-empty parts joined by ', ', the zip code appended when there is one."""
    line = F.concat_ws(", ", *[F.nullif(as_col(p), F.lit("")) for p in parts])
    if zip_code is None:
        return F.trim(line)
    return F.trim(F.concat_ws(" ", line, F.nullif(as_col(zip_code), F.lit(""))))


def is_retryable(status) -> Column:
    """Client errors are final; exceptions and 5xx answers are worth another try."""
    status = as_col(status)
    code = F.regexp_extract(status, r"^http_([0-9]+)$", 1).try_cast("int")
    return status.startswith("err:") | F.coalesce(code.between(500, 599), F.lit(False))


def score_status(status) -> Column:
    """Rank of an extraction status: the higher, the more useful the row."""
    status = as_col(status)
    return (F.when(status == "ok", 4).when(status == "no_images", 3)
            .when(status.contains("Too Many Requests"), 2)
            .when(F.lower(status).contains("internal error"), 1).otherwise(0))


def score_source(source, best: str = "building_patch") -> Column:
    return F.when(as_col(source) == best, 1).otherwise(0)


def render_record(name, country, sector, year, revenue, summary=None, cap: int = 800) -> Column:
    """One text record per row; only the description is capped, as the record format demands."""
    lines = [
        F.concat(F.lit("Company: "), as_col(name)),
        F.concat(F.lit("Country: "), as_col(country)),
        F.concat(F.lit("Sector (GICS): "), F.coalesce(as_col(sector), F.lit("Unknown"))),
        F.concat(F.lit("Reporting year: "), as_col(year).cast("int").cast("string")),
        F.format_string("Annual revenue: ~$%,.0f million USD", as_col(revenue)),
    ]
    if summary is not None:
        lines.append(F.concat(F.lit("Business description: "), F.substring(as_col(summary), 1, cap)))
    return F.concat_ws("\n", *lines)


# Fixed value: a number in prose, with thousands separators and an optional exponent.
NUMBER_IN_TEXT = r"(-?[0-9,]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?)"


def extract_number(c) -> Column:
    """First number in a text; null when there is none or it does not parse."""
    found = F.regexp_extract(as_col(c), NUMBER_IN_TEXT, 1)
    return parse_number(F.replace(found, F.lit(","), F.lit("")))


__all__ = [n for n in dir() if not n.startswith("_") and n not in
           ("annotations", "Column", "F", "as_col", "parse_number")]
