"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Only DataFrame and SQL functions. A pattern's matches and the text between them alternate, so their lengths
give the places of the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# Kinds in the order of the contract, the added ones after them, and their patterns. Possessive
# quantifiers and the tests of the character before only keep long runs linear; the matches are the same.
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "secret": r"[0-9a-f]{32,64}",
}
#: A text without this holds no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Score of a confirmed match, and what a word of its context adds.
SCORES = {
    "email": (0.9, 0.1, "mail|contact|write"),
    "ip": (0.6, 0.3, "address|server|host|login"),
    "card": (0.8, 0.2, "card|credit|visa|payment"),
    "phone": (0.7, 0.2, "phone|call|tel|mobile"),
    "iban": (0.6, 0.3, "iban|account|bank"),
    "secret": (0.3, 0.5, "token|secret|key|password"),
}
#: Added spans below this are left out; base kinds stay whatever their context.
LEAST = 0.5
NEAR = 40  #: code points before and after a span
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _digits(name: str) -> str:
    return f"translate({name}, ' -().+', '')"


def _valid(kind: str, name: str) -> str:
    """SQL: does the match pass the kind's checks?"""
    d = _digits(name)
    at = f"cast(substring({d}, length({d}) - i + 1, 1) as int)"
    if kind == "ip":
        return f"{name} rlike '^{BYTE}(?:[.]{BYTE}){{3}}$'"
    if kind == "phone":
        return f"length({d}) between 10 and 15"
    if kind == "card":
        luhn = f"aggregate(sequence(1, length({d})), 0L, (s, i) -> s + if(i % 2 = 0, (2 * {at}) div 10 + (2 * {at}) % 10, {at})) % 10 = 0"
        return f"if(length({d}) between 14 and 19, {luhn}, false)"
    if kind == "iban":
        t = f"translate({name}, ' ', '')"
        turned = f"concat(substring({t}, 5), substring({t}, 1, 4))"
        value = "if(c rlike '[0-9]', cast(c as int), ascii(c) - 55)"
        return f"if(length({t}) between 15 and 34, aggregate(filter(split({turned}, ''), c -> c <> ''), 0, (s, c) -> (s * if({value} > 9, 100, 10) + {value}) % 97) = 1, false)"
    return "true"


def _spans(kind: str) -> Column:
    """array<struct<s, e>>: places of the kind's confirmed matches in `text`, end exclusive."""
    pattern = PATTERNS[kind].replace("\\", "\\\\")
    none = "cast(array() as array<struct<s:int, e:int>>)"
    step = f"""aggregate(
      arrays_zip(split(text, '{pattern}', -1) as p, regexp_extract_all(text, '{pattern}', 0) as m),
      named_struct('pos', 0, 'out', {none}),
      (a, x) -> named_struct(
        'pos', a.pos + length(x.p) + coalesce(length(x.m), 0),
        'out', if(coalesce({_valid(kind, "x.m")}, false) and x.m is not null, concat(a.out, array(named_struct('s', a.pos + length(x.p), 'e', a.pos + length(x.p) + length(x.m)))), a.out)),
      a -> a.out)""".replace(" as p,", ",").replace("0) as m)", "0))").replace("x.p", "x.`0`").replace("x.m", "x.`1`")
    if kind in NEEDS:
        step = f"if(contains(text, '{NEEDS[kind]}'), {step}, {none})"
    return F.expr(step)


def find_pii(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs with `pii`: array<struct<start, end, kind_no, kind, score>> in order of start, then kind; places
    in code points, end exclusive. Spans of different kinds may overlap.

    Null and empty texts have none; a column named pii is replaced, the others stay as they are."""
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "pii"]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        rows = rows.withColumn(kind, _spans(kind))
    scored = []
    for no, kind in enumerate(KINDS):
        base, more, near = SCORES[kind]
        context = f"lower(substring(text, greatest(1, x.s - {NEAR} + 1), x.e - x.s + {2 * NEAR})) rlike '{near}'"
        one = f"transform(`{kind}`, x -> named_struct('start', x.s, 'end', x.e, 'kind_no', {no}, 'kind', '{kind}', 'score', {base}D + if({context}, {more}D, 0D)))"
        scored.append(one if no < 4 else f"filter({one}, x -> x.score >= {least})")
    return rows.select("row.*", F.expr(f"array_sort(concat({', '.join(scored)}))").alias("pii"))


def redact(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; overlapping spans give one mark, that
    of the first. A null text stays null; the columns stay as they are."""
    found = find_pii(docs.select(F.struct(*docs.columns).alias("own"), "text"), least)
    marked = F.expr(
        """aggregate(pii, named_struct('pos', 0, 'out', ''),
          (a, x) -> if(x.start >= a.pos,
            named_struct('pos', x.end, 'out', concat(a.out, substring(text, a.pos + 1, x.start - a.pos), '[', upper(x.kind), ']')),
            named_struct('pos', greatest(a.pos, x.end), 'out', a.out)),
          a -> concat(a.out, substring(text, a.pos + 1)))"""
    )
    text = F.when(F.size("pii") > 0, marked).otherwise(F.col("text"))
    return found.select(*[(text if c == "text" else F.col("own")[c]).alias(c) for c in docs.columns])


def op6_pii(spark, sf_dir: str) -> DataFrame:
    rows = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    said = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    counts = [F.expr(f"cast(size(filter(pii, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS[:4]]
    base = F.sha2(F.expr(said.format("filter(pii, x -> x.kind_no < 4)")), 256).alias("base_sha256")
    return rows.select("doc_id", *counts, base, F.expr(said.format("pii")).alias("spans"))


def _oracle() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": PATTERNS["phone"],
        "iban": PATTERNS["iban"],
        "secret": PATTERNS["secret"],
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (2 * CAST(substr({digits}, length({digits}) - i + 1, 1) AS INT)) // 10 + (2 * CAST(substr({digits}, length({digits}) - i + 1, 1) AS INT)) % 10 ELSE CAST(substr({digits}, length({digits}) - i + 1, 1) AS INT) END)) % 10 = 0"
    iban = "replace(m, ' ', '')"
    number = f"array_to_string(list_transform(string_split(substr({iban}, 5) || substr({iban}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), '')"
    mod = f"list_reduce(list_prepend(0, list_transform(string_split({number}, ''), lambda c: CAST(c AS INT))), lambda a, b: (a * 10 + b) % 97) = 1"
    tests = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(m, '.'), lambda x: TRY_CAST(x AS HUGEINT))) <= 255",
        "card": f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {luhn} ELSE false END",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "iban": f"CASE WHEN length({iban}) BETWEEN 15 AND 34 THEN {mod} ELSE false END",
        "secret": f"regexp_matches(lower(substr(text, greatest(1, s - {NEAR} + 1), e - s + {2 * NEAR})), '{SCORES['secret'][2]}')",
    }
    parts = []
    for no, kind in enumerate(KINDS):
        parts.append(
            f"""SELECT uid, {no} AS no, '{kind}' AS kind, s, e FROM (
              SELECT uid, text, m, CAST(sum(length(p)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s,
                     CAST(sum(length(p)) OVER w + sum(length(m)) OVER w AS BIGINT) AS e
              FROM (SELECT uid, text, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p
                    FROM (SELECT uid, text, regexp_extract_all(text, '{plain[kind]}') AS ms, string_split_regex(text, '{plain[kind]}') AS ps FROM d))
              WINDOW w AS (PARTITION BY uid ORDER BY i)) WHERE {tests[kind]}"""
        )
    union = " UNION ALL ".join(parts)
    counts = ", ".join(f"count(kind) FILTER (kind = '{k}') AS n_{k}" for k in KINDS[:4])
    said = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no)"
    return f"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
      f AS ({union})
      SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce({said} FILTER (no < 4), '')) AS base_sha256, coalesce({said}, '') AS spans
      FROM d LEFT JOIN f USING (uid) GROUP BY uid"""


OP6_SQL = _oracle()
