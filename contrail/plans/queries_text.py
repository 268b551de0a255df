"""Transcript entities and citations over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.functions import text as tx
from contrail.operators import joins, voice
from contrail.plans import views
from contrail.plans.registry import R, r, register

# Fixed phrase templates around the turns' own numbers: the stored prose holds hardly any radio speech.
PHRASES = (
    "united {a} turn left heading {b} climb and maintain flight level {c}",
    "november {d} alpha bravo cleared for takeoff runway {e}l contact tower {f}.{g}",
    "speedbird {a} descend and maintain {d} thousand feet speed {h} knots direct KNOWN",
    "AAL{a} squawk {i} mayday mayday hold short rwy {e}",
    "pan pan delta {a} squawking {i} maintain {j} feet expedite climb",
)


def spoken(spark, sf):
    """Conversation turns with a radio phrase built from their ids put before the whole text."""
    cid, turn = F.col("conv_id"), F.col("turn")
    n = cid * 7 + turn * 13
    parts = {
        "{a}": (n % 989 + 10), "{b}": (n % 36 * 10 + 100), "{c}": (n % 30 * 10 + 100), "{d}": (n % 19 + 1),
        "{e}": (n % 36 + 1), "{f}": (n % 25 + 115), "{g}": (n % 9 * 25 + 1), "{h}": (n % 70 * 10),
        "{i}": (n % 7 * 1111 + 1200), "{j}": (n % 400 * 100 + 200),
    }
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (n % len(PHRASES) + 1).cast("int"))
    for slot, value in parts.items():
        phrase = F.replace(phrase, F.lit(slot), value.cast("string"))
    return views.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat_ws(" ", phrase, F.coalesce("text", F.lit(""))).alias("text")
    )


# DuckDB's patterns know ASCII words only. The SQL writes letters of other scripts as ``_``, a word character that no
# pattern asks for, and other marks as a space; the operators see whole texts, and where a query returns text, its
# result is written that way as well.
FOREIGN = r"[ªµºÀ-ÖØ-öø-ʯ\x{370}-\x{373}\x{386}\x{388}-\x{52F}\x{4E00}-\x{9FFF}]"


def ascii_words(column):
    return F.regexp_replace(F.regexp_replace(column, FOREIGN, "_"), r"[^\x00-\x7F]", " ")


def ascii_words_sql(column: str) -> str:
    return f"regexp_replace(regexp_replace(replace({column}, 'ß', 'SS'), '{FOREIGN}', '_', 'g'), '[^\\x00-\\x7F]', ' ', 'g')"


def spoken_sql() -> str:
    values = {
        "{a}": "n % 989 + 10", "{b}": "n % 36 * 10 + 100", "{c}": "n % 30 * 10 + 100", "{d}": "n % 19 + 1",
        "{e}": "n % 36 + 1", "{f}": "n % 25 + 115", "{g}": "n % 9 * 25 + 1", "{h}": "n % 70 * 10",
        "{i}": "n % 7 * 1111 + 1200", "{j}": "n % 400 * 100 + 200",
    }
    phrase = "[" + ", ".join(f"'{p}'" for p in PHRASES) + f"][CAST(n % {len(PHRASES)} + 1 AS INTEGER)]"
    for slot, value in values.items():
        phrase = f"replace({phrase}, '{slot}', CAST({value} AS VARCHAR))"
    return f"""spoken AS (SELECT conv_id, turn, {phrase} || ' ' ||
      {ascii_words_sql("coalesce(text, '')")} AS text
      FROM (SELECT *, conv_id * 7 + turn * 13 AS n FROM conversations))"""


def normalize_sql(column: str) -> str:
    out = f"upper({column})"
    for word, symbol in {**tx.PHONETIC, **tx.DIGITS}.items():
        out = f"regexp_replace({out}, '\\b{word}\\b', '{symbol}', 'g')"
    return out


NORM = f"WITH {spoken_sql()}, norm AS (SELECT conv_id, turn, upper(text) AS u, {normalize_sql('text')} AS n FROM spoken)"
# lists come back sorted and joined, so only their members are compared
JOINED = "coalesce(array_to_string(list_sort(list_distinct({x})), ','), '')"


def listed(expr: str, name: str) -> str:
    return f"{NORM} SELECT conv_id, turn, {JOINED.format(x=expr)} AS {name} FROM norm"


def found(name: str, group: int = 1, source: str = "n") -> str:
    return f"regexp_extract_all({source}, '{tx.PATTERNS[name]}', {group})"


def _entity(kind: str, sql: str):
    @register(f"entity_{kind}", listed(sql, kind))
    def run(spark, sf):
        d = tx.with_entities(spoken(spark, sf), "text", [kind])
        values = F.array_sort(F.transform(kind, lambda v: v.cast("string")))
        if kind == "frequencies":
            values = F.array_sort(F.transform(kind, lambda v: F.format_string("%.3f", v)))
        elif kind in ("altitudes", "headings", "speeds"):
            values = F.transform(F.array_sort(kind), lambda v: v.cast("string"))
        return d.select("conv_id", "turn", F.array_join(values, ",").alias(kind))

    return run


STRIP = "lambda x: regexp_replace(x, '\\s', '', 'g')"
NAMED = ", ".join(
    f"list_transform(regexp_extract_all(u, '\\b{name}\\s*(\\d{{1,4}}[A-Z]?)\\b', 1), lambda x: '{code}' || x)"
    for name, code in tx.AIRLINES.items()
)
CALLSIGNS = (
    f"flatten([list_transform({found('airline_callsign', 0)}, {STRIP}), list_transform(list_transform("
    f"{found('n_number', 0)}, {STRIP}), lambda x: regexp_replace(x, '^NOVEMBER', 'N')), {NAMED}])"
)
RUNWAYS = f"list_transform(list_zip({found('runway', 1)}, {found('runway', 2)}), lambda x: lpad(x[1], 2, '0') || x[2])"
INT = "lambda x: CAST(x AS INTEGER)"
ALTITUDES = (
    f"flatten([list_transform({found('flight_level')}, lambda x: CAST(x AS INTEGER) * 100),"
    f" list_transform({found('altitude_thousand')}, lambda x: CAST(x AS INTEGER) * 1000),"
    f" list_transform({found('altitude_feet')}, {INT})])"
)
HEADINGS = f"list_filter(list_transform({found('heading')}, {INT}), lambda x: x BETWEEN 0 AND 360)"
FREQUENCIES = (
    f"list_transform(list_filter(list_transform(list_zip({found('frequency', 1)}, {found('frequency', 2)}),"
    " lambda x: CAST(x[1] || '.' || x[2] AS DOUBLE)), lambda x: x BETWEEN 118 AND 137), lambda x: format('{:.3f}', x))"
)
SQUAWKS = f"list_filter({found('squawk')}, lambda x: regexp_full_match(x, '[0-7]{{4}}'))"
SPEEDS = f"list_filter(list_transform({found('speed')}, {INT}), lambda x: x BETWEEN 50 AND 600)"
STOP = "[" + ", ".join(f"'{w}'" for w in tx.NOT_WAYPOINTS) + "]"
WAYPOINTS = f"list_filter({found('waypoint')}, lambda x: NOT list_contains({STOP}, x))"

_entity("callsigns", CALLSIGNS)
_entity("runways", RUNWAYS)
_entity("altitudes", ALTITUDES)
_entity("headings", HEADINGS)
_entity("frequencies", FREQUENCIES)
_entity("squawks", SQUAWKS)
_entity("speeds", SPEEDS)
_entity("waypoints", WAYPOINTS)

PREFIXED = "list_transform({found}, lambda x: '{word} ' || x)"
INSTRUCTIONS = (
    "flatten(["
    + ", ".join(
        PREFIXED.format(found=found(k, 1, "u"), word=k.upper()) for k in ("cleared", "turn", "contact")
    )
    + ", "
    + ", ".join(f"CASE WHEN regexp_matches(u, '\\b{c}\\b') THEN ['{c}'] ELSE [] END" for c in tx.COMMANDS)
    + "])"
)


@register(
    "entity_instructions",
    f"{NORM} SELECT conv_id, turn, coalesce(array_to_string({INSTRUCTIONS}, ';'), '') AS instructions FROM norm",
)
def entity_instructions(spark, sf):
    d = tx.with_entities(spoken(spark, sf), "text", ["instructions"])
    return d.select("conv_id", "turn", ascii_words(F.array_join("instructions", ";")).alias("instructions"))


SPOKEN_EMERGENCY = " OR ".join(f"contains(u, '{w}')" for w in tx.EMERGENCY_WORDS)


@register(
    "emergency_communications",
    f"""{NORM} SELECT conv_id, turn, len(list_filter({SQUAWKS}, lambda x: x IN ('7500', '7600', '7700'))) > 0
    OR {SPOKEN_EMERGENCY} AS is_emergency FROM norm""",
)
def emergency_communications(spark, sf):
    return tx.with_entities(spoken(spark, sf), "text", ["is_emergency"]).select("conv_id", "turn", "is_emergency")


@register(
    "normalized_text",
    f"""WITH d AS (SELECT doc_id, {ascii_words_sql('text')} AS text FROM documents)
    SELECT doc_id, md5({normalize_sql('text')}) AS digest FROM d""",
)
def normalized_text(spark, sf):
    d = views.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(ascii_words(tx.normalize_atc(F.col("text")))).alias("digest"))


@register(
    "document_entities",
    f"""WITH d AS (SELECT doc_id, {ascii_words_sql('text')} AS text FROM documents),
    norm AS (SELECT doc_id, upper(text) AS u, {normalize_sql('text')} AS n FROM d)
    SELECT doc_id, len(list_distinct({WAYPOINTS})) AS waypoints, len(list_distinct({CALLSIGNS})) AS callsigns,
    len(list_distinct({FREQUENCIES})) AS frequencies, {SPOKEN_EMERGENCY} AS spoken_emergency FROM norm""",
)
def document_entities(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", "text")
    e = tx.with_entities(d, "text", ["waypoints", "callsigns", "frequencies", "is_emergency"])
    size = lambda c: F.size(c).cast("long").alias(c)
    return e.select("doc_id", size("waypoints"), size("callsigns"), size("frequencies"),
                    F.col("is_emergency").alias("spoken_emergency"))


@register(
    "transcript_confidence",
    f"""SELECT conv_id, {R('coalesce(exp(avg(lp)), 0.5)', 6)} AS confidence, coalesce(exp(avg(lp)), 0.5) < 0.7 AS abstained
    FROM (SELECT conv_id, CASE WHEN turn % 5 <> 4 THEN -(length(text) % 50) / 40.0::DOUBLE END AS lp FROM conversations)
    GROUP BY conv_id""",
)
def transcript_confidence(spark, sf):
    d = views.table(spark, sf, "conversations").select(
        "conv_id", F.when(F.col("turn") % 5 != 4, -(F.length("text") % 50) / 40.0).alias("avg_logprob")
    )
    return voice.transcript_confidence(d, keys=["conv_id"]).withColumn("confidence", r("confidence", 6))


def responses(spark, sf):
    """Documents as answers citing facts of their own row, some of them wrong."""
    d = views.table(spark, sf, "documents")
    wrong = F.when(F.col("doc_id") % 4 == 0, "999999").otherwise(F.col("n_chars").cast("string"))
    cite = F.concat(
        F.lit("Found [Evidence: n_chars="), wrong, F.lit(", source=documents] in [Evidence: lang="),
        F.substring("lang", 1, 1), F.lit("] "), F.coalesce("text", F.lit("")),
    )
    return d.select(F.col("doc_id").alias("response_id"), F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(cite).alias("text"))


def result_rows(spark, sf):
    d = views.table(spark, sf, "documents")
    pairs = F.array(
        F.struct(F.lit("n_chars").alias("field"), F.col("n_chars").cast("string").alias("value")),
        F.struct(F.lit("lang").alias("field"), F.col("lang").alias("value")),
    )
    return d.select(F.col("doc_id").alias("response_id"), F.inline(pairs))


CITE = r"\[Evidence:\s*(\w+)=([^,\]]+)(?:,\s*source=(\w+))?\]"


@register(
    "citation_audit",
    f"""WITH resp AS (SELECT doc_id, n_chars, lang, CASE WHEN doc_id % 7 = 0 THEN text ELSE 'Found [Evidence: n_chars=' ||
      CASE WHEN doc_id % 4 = 0 THEN '999999' ELSE CAST(n_chars AS VARCHAR) END || ', source=documents] in [Evidence: lang='
      || substr(lang, 1, 1) || '] ' || coalesce(text, '') END AS text FROM documents),
    c AS (SELECT doc_id, n_chars, lang, unnest(regexp_extract_all(text, '{CITE}', 1)) AS field,
      unnest(regexp_extract_all(text, '{CITE}', 2)) AS value FROM resp),
    j AS (SELECT *, CASE field WHEN 'n_chars' THEN contains(CAST(n_chars AS VARCHAR), value)
      WHEN 'lang' THEN contains(lang, value) ELSE false END AS ok FROM c),
    g AS (SELECT doc_id, count(*) AS citations, count(*) FILTER (coalesce(ok, false)) AS verified FROM j GROUP BY doc_id)
    SELECT resp.doc_id AS response_id, coalesce(citations, 0) AS citations, coalesce(verified, 0) AS verified,
      {R('least(1.0::DOUBLE, coalesce(verified / citations::DOUBLE, 0.5) * 0.9::DOUBLE + 0.1::DOUBLE)', 6)} AS confidence,
      coalesce(citations - verified, 0) AS warnings
    FROM resp LEFT JOIN g USING (doc_id)""",
)
def citation_audit(spark, sf):
    d = joins.audit_citations(responses(spark, sf), result_rows(spark, sf))
    return d.withColumns({"confidence": r("confidence", 6), "warnings": F.size("warnings").cast("long")})
