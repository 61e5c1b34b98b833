"""Quality rules: a threshold table compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STOP_WORDS = (
    "the be to of and that have with in is it for on as was are this by or an "
    "le la les de des du et en un une est que qui dans pour sur au par pas "
    "der die das und ist den von zu mit auf für ein eine nicht dem sich im "
    "el los las y del se con por para su lo al es una como"
).split()
SYMBOLS = "#$%&*+<=>@^_{|}~!\\"


@dataclass(frozen=True)
class Rule:
    """A measure and the least and greatest value at which a document is kept; from ``words`` words on."""

    name: str
    least: float | None
    most: float | None
    words: int = 0


#: Rules in order; the first that fails is the reason given.
RULES = (
    Rule("n_words", 1, None),
    Rule("mean_word_length", 2, 12),
    Rule("symbols_per_word", None, 0.35, 10),
    Rule("upper_share", None, 0.35, 10),
    Rule("stop_word_share", 0.03, None, 50),
    Rule("repeated_word_share", None, 0.25, 10),
    Rule("repeated_line_share", None, 0.6, 10),
    Rule("bullet_line_share", None, 0.9, 50),
    Rule("ellipsis_line_share", None, 0.4, 50),
)

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
_SYMBOLS_SPARK = SYMBOLS.replace("\\", "\\\\")


def _measures(text: str) -> list[dict[str, str]]:
    """Return Spark SQL of the measures, in layers of which each uses the one before."""
    share = "cast({} as double) / greatest({}, 1)".format
    return [
        {"__t": f"coalesce(`{text}`, '')"},
        {
            "__w": "filter(split(__t, '[ \\\\t\\\\n\\\\r]+'), x -> x <> '')",
            "__l": "filter(transform(split(__t, '\\\\n'), x -> trim(x)), x -> x <> '')",
            "__chars": "length(__t)",
            "__symbols": f"length(__t) - length(translate(__t, '{_SYMBOLS_SPARK}', ''))",
            "__upper": "length(__t) - length(translate(__t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))",
            "__letters": "length(__t) - length(translate(__t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', ''))",
        },
        {"__n": "cast(size(__w) as bigint)", "__lines": "size(__l)", "__black": "length(regexp_replace(__t, '[ \\\\t\\\\n\\\\r]+', ''))"},
        {
            "n_words": "__n",
            "mean_word_length": share("__black", "__n"),
            "symbols_per_word": share("__symbols", "__n"),
            "upper_share": share("__upper", "__letters"),
            "stop_word_share": share(f"size(filter(__w, x -> lower(x) in ({_STOP})))", "__n"),
            "repeated_word_share": share("size(filter(__w, (x, i) -> i > 0 and x = element_at(__w, greatest(i, 1))))", "__n"),
            "repeated_line_share": share("__lines - size(array_distinct(__l))", "__lines"),
            "bullet_line_share": share("size(filter(__l, x -> substring(x, 1, 1) in ('-', '*', '•')))", "__lines"),
            "ellipsis_line_share": share("size(filter(__l, x -> x like '%...' or x like '%…'))", "__lines"),
        },
    ]


def _verdict(rules: tuple[Rule, ...]) -> str:
    """Return SQL, good in Spark and DuckDB, for the name of the first rule that fails, or null."""
    cases = []
    for r in rules:
        bad = " or ".join([f"{r.name} < {r.least}"] * (r.least is not None) + [f"{r.name} > {r.most}"] * (r.most is not None))
        cases.append(f"when n_words >= {r.words} and ({bad}) then '{r.name}'")
    return "case " + " ".join(cases) + " end"


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Return ``(doc_id, n_words, <eight measures>, failed_rule, keep)`` for each row.

    The table of rules becomes one chain of projections of built-in functions
    over a single scan: no shuffle and no Python. Words are runs without blanks,
    lines are those with a word; an empty or null text has no word and fails
    ``n_words``. Rules with a word count don't bind shorter documents. Repeated
    rows are judged alike, an empty table gives an empty result, a null key
    stays null, a text of any length is judged whole and never rejected for its
    length, and other columns of any name don't matter.
    """
    df = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__text"))
    for layer in _measures("__text"):
        df = df.withColumns({name: F.expr(sql) for name, sql in layer.items()})
    names = list(_measures("")[-1])
    failed = F.expr(_verdict(rules))
    rounded = [F.round(n, 9).alias(n) if n != "n_words" else F.col(n) for n in names]
    return df.select("doc_id", *rounded, failed.alias("failed_rule"), failed.isNull().alias("keep"))


_D = "CAST({} AS DOUBLE) / greatest({}, 1)".format
ORACLE = f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l,
  length(t) - length(translate(t, '{SYMBOLS}', '')) AS symbols,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper_n,
  length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS letters,
  length(regexp_replace(t, '[ \\t\\n\\r]+', '', 'g')) AS black FROM a),
c AS (SELECT *, CAST(len(w) AS BIGINT) AS n_words, len(l) AS lines FROM b),
d AS (SELECT doc_id, n_words,
  {_D("black", "n_words")} AS mean_word_length, {_D("symbols", "n_words")} AS symbols_per_word, {_D("upper_n", "letters")} AS upper_share,
  {_D(f"len(list_filter(w, lambda x: lower(x) IN ({_STOP})))", "n_words")} AS stop_word_share,
  {_D("len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1]))", "n_words")} AS repeated_word_share,
  {_D("lines - len(list_distinct(l))", "lines")} AS repeated_line_share,
  {_D("len(list_filter(l, lambda x: substring(x, 1, 1) IN ('-', '*', '•')))", "lines")} AS bullet_line_share,
  {_D("len(list_filter(l, lambda x: x LIKE '%...' OR x LIKE '%…'))", "lines")} AS ellipsis_line_share FROM c)
SELECT doc_id, n_words, {", ".join(f"round({r.name}, 9) AS {r.name}" for r in RULES[1:])},
  {_verdict(RULES)} AS failed_rule, ({_verdict(RULES)}) IS NULL AS keep FROM d
"""
