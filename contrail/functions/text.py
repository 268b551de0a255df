"""Entities in air-traffic transcripts, as native string and array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spelling alphabet.
PHONETIC = {
    "ALPHA": "A", "BRAVO": "B", "CHARLIE": "C", "DELTA": "D", "ECHO": "E", "FOXTROT": "F", "GOLF": "G",
    "HOTEL": "H", "INDIA": "I", "JULIET": "J", "KILO": "K", "LIMA": "L", "MIKE": "M", "NOVEMBER": "N",
    "OSCAR": "O", "PAPA": "P", "QUEBEC": "Q", "ROMEO": "R", "SIERRA": "S", "TANGO": "T", "UNIFORM": "U",
    "VICTOR": "V", "WHISKEY": "W", "XRAY": "X", "YANKEE": "Y", "ZULU": "Z",
}

# Spoken digits.
DIGITS = {
    "ZERO": "0", "ONE": "1", "TWO": "2", "THREE": "3", "FOUR": "4", "FIVE": "5", "SIX": "6", "SEVEN": "7",
    "EIGHT": "8", "NINE": "9", "NINER": "9",
}

# Airline telephony names and their codes.
AIRLINES = {
    "AMERICAN": "AAL", "UNITED": "UAL", "DELTA": "DAL", "SOUTHWEST": "SWA", "JETBLUE": "JBU", "ALASKA": "ASA",
    "SPIRIT": "NKS", "FRONTIER": "FFT", "HAWAIIAN": "HAL", "CACTUS": "AWE", "SPEEDBIRD": "BAW",
    "LUFTHANSA": "DLH", "AIR FRANCE": "AFR", "KLMROYAL": "KLM", "SHAMROCK": "EIN",
}

# Five-letter words that are not waypoints.
NOT_WAYPOINTS = (
    "ROGER", "CLEAR", "TOWER", "RADAR", "DELTA", "ALPHA", "BRAVO", "OSCAR", "INDIA", "ROMEO", "HOTEL",
    "NORTH", "SOUTH", "SPEED", "LEVEL", "HEAVY", "LIGHT",
)

# Patterns of the entities. Word boundaries and word characters are those of any script (``UNICODE``),
# digits are 0-9.
PATTERNS = {
    "airline_callsign": r"\b[A-Z]{2,3}\s*\d{1,4}[A-Z]?\b",
    "n_number": r"\b(?:N|NOVEMBER)\s*\d{1,5}[A-Z]{0,2}\b",
    "runway": r"\b(?:RUNWAY|RWY)\s*(\d{1,2})\s*([LRC]?)\b",
    "flight_level": r"\bFLIGHT\s*LEVEL\s*(\d{2,3})\b",
    "altitude_thousand": r"\b(\d{1,2})\s*THOUSAND(?:\s+FEET)?\b",
    "altitude_feet": r"\b(\d{3,5})\s*(?:FEET|FT)\b",
    "heading": r"\bHEADING\s*(\d{3})\b",
    "frequency": r"\b(\d{3})\s*[.]?\s*(\d{1,3})\b",
    "squawk": r"\bSQUAWK\s*(\d{4})\b",
    "speed": r"\b(\d{2,3})\s*KNOTS\b",
    "cleared": r"\bCLEARED\s+(?:FOR\s+)?(\w+(?:\s+\w+)?)",
    "turn": r"\bTURN\s+(LEFT|RIGHT)",
    "contact": r"\bCONTACT\s+(\w+)",
    "waypoint": r"\b([A-Z]{5})\b",
}

# Fixed values.
COMMANDS = ("CLIMB", "DESCEND", "HOLD", "EXPEDITE")
EMERGENCY_WORDS = ("MAYDAY", "PAN PAN", "EMERGENCY", "DECLARING")
EMERGENCY_CODES = ("7500", "7600", "7700")


UNICODE = "(?U)"


#: What a text must hold for a pattern to match at all: one of these words, or a digit.
NEEDED = {
    "runway": ("RUNWAY", "RWY"), "flight_level": ("LEVEL",), "altitude_thousand": ("THOUSAND",), "altitude_feet": ("FEET", "FT"),
    "heading": ("HEADING",), "squawk": ("SQUAWK",), "speed": ("KNOTS",), "cleared": ("CLEARED",), "turn": ("TURN",),
    "contact": ("CONTACT",), "airline_callsign": (), "n_number": (), "frequency": (),
}


def _possible(text: Column, words: tuple[str, ...]) -> Column:
    """A plain search before the pattern, which looks at every word boundary of a text of any script."""
    if not words:
        return text.rlike("[0-9]")
    found = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(text, F.lit(word))
    return found


def _all(text: Column, name: str, group: int = 1) -> Column:
    found = F.regexp_extract_all(text, F.lit(UNICODE + PATTERNS[name].replace(r"\d", "[0-9]")), F.lit(group))
    if name not in NEEDED:
        return found
    return F.when(~_possible(text, NEEDED[name]), F.array().cast("array<string>")).otherwise(found)


def _ints(values: Column) -> Column:
    return F.transform(values, lambda v: v.cast("int"))


def normalize_atc(text: Column) -> Column:
    """Upper case, spelled letters and digits replaced by themselves.

    One pass cuts a text into words and what is between them, and each word is
    looked up. Texts without any of the words are left as they are.
    """
    table = {**PHONETIC, **DIGITS}
    symbols = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    upper = F.upper(text)
    parts = F.regexp_extract_all(upper, F.lit(UNICODE + r"\w+|\W+"), F.lit(0))
    # all words of the table have three to eight letters
    put = lambda part: F.when(F.octet_length(part).between(3, 8), F.coalesce(F.try_element_at(symbols, part), part)).otherwise(part)
    spelled = F.array_join(F.transform(parts, put), "")
    return F.when(upper.rlike(UNICODE + r"\b(?:" + "|".join(table) + r")\b"), spelled).otherwise(upper)


def callsigns(normalized: Column, upper: Column) -> Column:
    compact = lambda match: F.regexp_replace(match, r"\s", "")
    codes = F.transform(_all(normalized, "airline_callsign", 0), compact)
    tails = F.transform(
        _all(normalized, "n_number", 0), lambda m: F.regexp_replace(compact(m), "^NOVEMBER", "N")
    )
    # airline names are read before normalisation, which would turn DELTA into D
    name = UNICODE + r"\b(" + "|".join(AIRLINES) + r")\s*([0-9]{1,4}[A-Z]?)\b"
    code = F.create_map(*[F.lit(x) for pair in AIRLINES.items() for x in pair])
    said = F.zip_with(
        F.regexp_extract_all(upper, F.lit(name), F.lit(1)),
        F.regexp_extract_all(upper, F.lit(name), F.lit(2)),
        lambda airline, number: F.concat(F.element_at(code, airline), number),
    )
    by_name = F.when(~_possible(upper, ()), F.array().cast("array<string>")).otherwise(said)
    return F.array_distinct(F.concat(codes, tails, by_name))


def runways(normalized: Column) -> Column:
    padded = F.zip_with(
        _all(normalized, "runway", 1), _all(normalized, "runway", 2), lambda n, side: F.concat(F.lpad(n, 2, "0"), side)
    )
    return F.array_distinct(padded)


def altitudes(normalized: Column) -> Column:
    return F.array_distinct(
        F.concat(
            F.transform(_all(normalized, "flight_level"), lambda v: v.cast("int") * 100),
            F.transform(_all(normalized, "altitude_thousand"), lambda v: v.cast("int") * 1000),
            _ints(_all(normalized, "altitude_feet")),
        )
    )


def headings(normalized: Column) -> Column:
    return F.array_distinct(F.filter(_ints(_all(normalized, "heading")), lambda h: h.between(0, 360)))


def frequencies(normalized: Column) -> Column:
    values = F.zip_with(
        _all(normalized, "frequency", 1),
        _all(normalized, "frequency", 2),
        lambda whole, part: F.concat(whole, F.lit("."), part).cast("double"),
    )
    return F.array_distinct(F.filter(values, lambda f: f.between(118, 137)))


def squawks(normalized: Column) -> Column:
    return F.array_distinct(F.filter(_all(normalized, "squawk"), lambda s: s.rlike("^[0-7]{4}$")))


def speeds(normalized: Column) -> Column:
    return F.array_distinct(F.filter(_ints(_all(normalized, "speed")), lambda s: s.between(50, 600)))


def instructions(upper: Column) -> Column:
    """Clearances, turns, contacts and commands, in that order, duplicates kept."""
    prefixed = lambda word, found: F.transform(found, lambda v: F.concat(F.lit(f"{word} "), v))
    commands = [
        F.when(F.contains(upper, F.lit(c)) & upper.rlike(rf"{UNICODE}\b{c}\b"), F.array(F.lit(c))).otherwise(F.array().cast("array<string>")) for c in COMMANDS
    ]
    return F.concat(
        prefixed("CLEARED", _all(upper, "cleared")),
        prefixed("TURN", _all(upper, "turn")),
        prefixed("CONTACT", _all(upper, "contact")),
        *commands,
    )


def waypoints(normalized: Column) -> Column:
    return F.array_except(_all(normalized, "waypoint"), F.array(*[F.lit(w) for w in NOT_WAYPOINTS]))


def is_emergency_text(squawk_codes: Column, upper: Column) -> Column:
    spoken = F.lit(False)
    for word in EMERGENCY_WORDS:
        spoken = spoken | F.contains(upper, F.lit(word))
    return F.arrays_overlap(squawk_codes, F.array(*[F.lit(c) for c in EMERGENCY_CODES])) | spoken


def with_entities(df, text: str = "text", kinds: list[str] | None = None):
    """Add one column per entity kind plus ``is_emergency``; normalisation runs once per row."""
    d = df.withColumn("_upper", F.upper(F.col(text))).withColumn("_norm", normalize_atc(F.col(text)))
    norm, upper = F.col("_norm"), F.col("_upper")
    table = {
        "callsigns": callsigns(norm, upper),
        "runways": runways(norm),
        "altitudes": altitudes(norm),
        "headings": headings(norm),
        "frequencies": frequencies(norm),
        "instructions": instructions(upper),
        "squawks": squawks(norm),
        "speeds": speeds(norm),
        "waypoints": waypoints(norm),
    }
    wanted = kinds or [*table, "is_emergency"]
    columns = [table[k].alias(k) for k in table if k in wanted]
    if "is_emergency" in wanted:
        columns.append(is_emergency_text(squawks(norm), upper).alias("is_emergency"))
    return d.select(*df.columns, *columns)


def entities(df, text: str = "text"):
    """All entities as one struct column ``entities``, the raw text included."""
    d = with_entities(df, text)
    parts = [c for c in d.columns if c not in df.columns and c != "is_emergency"]
    return d.select(*df.columns, F.struct(*parts, F.col(text).alias("raw_text")).alias("entities"), "is_emergency")
