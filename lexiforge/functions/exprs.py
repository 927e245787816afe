"""Column expressions with the semantics of Python's str and re, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """str.strip: all Unicode white space at both ends (trim() would remove spaces only)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def squash(c) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)\s+", " "), "^ | $", "")


def clean_str(c) -> Column:
    """Null, NaN and the word nan become the empty string; the rest is stripped."""
    text = strip(col(c).cast("string"))
    return F.when(F.lower(text) == "nan", "").otherwise(F.coalesce(text, F.lit("")))


def none_if_empty(c) -> Column:
    return F.nullif(col(c), F.lit(""))


def words(c) -> Column:
    """str.split()."""
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c) -> Column:
    return F.size(words(c))


def pick_first(columns: list[str], candidates: list[str]) -> Column:
    """First candidate column, in order, that exists and is not empty once cleaned; '' if none."""
    found = [none_if_empty(clean_str(c)) for c in candidates if c in columns]
    return F.coalesce(*found, F.lit(""))


def straight_quotes(c) -> Column:
    return F.translate(col(c), "’", "'")


def apostrophes(c) -> Column:
    return F.length(col(c)) - F.length(F.replace(col(c), F.lit("'"), F.lit("")))


def contains_any(c, needles: list[str]) -> Column:
    """Is any needle in the lower-cased text with a space at both ends; no needles: yes."""
    if not needles:
        return F.lit(True)
    padded = F.concat(F.lit(" "), F.lower(col(c)), F.lit(" "))
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(padded, F.lit(needle.lower()))
    return out


def hits(c, patterns: dict[str, str]) -> Column:
    """Names of all patterns that are found, in the order given."""
    return F.array_compact(F.array(*(F.when(col(c).rlike(p), F.lit(name)) for name, p in patterns.items())))


def strip_code_fence(c) -> Column:
    """Text inside a ``` fence, without the word json in front."""
    text = strip(c)
    inner = F.regexp_replace(F.regexp_replace(text, r"^```[a-zA-Z]*", ""), r"```$", "")
    return strip(F.regexp_replace(strip(inner), r"^json(?=\s)", ""))


def capitalize(c) -> Column:
    """str.capitalize: first letter upper, the rest lower."""
    return F.concat(F.upper(F.substr(col(c), F.lit(1), F.lit(1))), F.lower(F.substr(col(c), F.lit(2))))


def unescape(c) -> Column:
    """Written-out line ends and tabs of command lines become characters."""
    out = F.replace(col(c), F.lit(r"\r\n"), F.lit("\n"))
    return F.replace(F.replace(out, F.lit(r"\n"), F.lit("\n")), F.lit(r"\t"), F.lit("\t"))


def shorten(c, most: int = 11) -> Column:
    return F.when(F.length(col(c)) > most, F.concat(F.left(col(c), F.lit(most)), F.lit("..."))).otherwise(col(c))


def slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), "^_|_$", "")


def segments(c) -> Column:
    """Sentences, lines and clauses; where that gives fewer than two, parts between commas."""
    text = strip(c)
    chunks = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+|(?<=[;:])\s+"), strip), lambda s: s != "")
    parts = F.filter(F.transform(F.split(text, r"\s*,\s*"), strip), lambda s: s != "")
    return F.when(F.size(chunks) < 2, parts).otherwise(chunks)


def alpaca_prompt(instruction, given, output=None, system: str | None = None) -> Column:
    """The instruction template, with or without input; system puts an anchor in front; output is appended."""
    with_input = F.concat(F.lit("### Instruction:\n"), col(instruction), F.lit("\n\n### Input:\n"), col(given), F.lit("\n\n### Response:\n"))
    without = F.concat(F.lit("### Instruction:\n"), col(instruction), F.lit("\n\n### Response:\n"))
    out = F.when(F.coalesce(col(given), F.lit("")) != "", with_input).otherwise(without)
    out = F.concat(F.lit(f"### System:\n{system}\n\n"), out) if system else out
    return out if output is None else F.concat(out, col(output))


def seeded_hash(seed, *keys) -> Column:
    """32 hex digits that order rows the same way in every partitioning and in other engines."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(col(k).cast("string") for k in keys)))


def seeded_index(n, seed, *keys) -> Column:
    """A choice from 0 to n - 1."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(F.conv(F.substr(seeded_hash(seed, *keys), F.lit(1), F.lit(8)), 16, 10).cast("long"), n)


def is_close(a, b, rel: float = 1e-9, absolute: float = 1e-12) -> Column:
    a, b = col(a), col(b)
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def wilson(k, n, upper: bool) -> Column:
    """Bound of the 95 % Wilson interval; null for n <= 0."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p, z2 = k / n, Z95 * Z95
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    value = (p + z2 / (2 * n) + (half if upper else -half)) / (1 + z2 / n)
    return F.when(n > 0, value)


def log_gamma(x) -> Column:
    """ln of the gamma function for x >= 1, by Stirling's series of x + 8."""
    x = col(x).cast("double")
    far = x + 8
    series = 1 / (12 * far) - 1 / (360 * far**3) + 1 / (1260 * far**5) - 1 / (1680 * far**7)
    start = (far - 0.5) * F.ln(far) - far + 0.9189385332046727 + series
    for k in range(8):
        start = start - F.ln(x + k)
    return start


def binomial_p(k, n) -> Column:
    """Exact two-sided p value at one half: the probability of all outcomes not likelier than k.

    That is twice the lower tail up to the smaller of k and n - k. Terms fall from its end, and those further
    away than 40 standard deviations add nothing in double precision: the work follows the root of n.
    """
    k, n = col(k).cast("long"), col(n).cast("long")
    m = F.least(k, n - k)
    top = F.exp(log_gamma(n + 1) - log_gamma(m + 1) - log_gamma(n - m + 1) - n * F.ln(F.lit(2.0)))
    steps = F.least(m, F.ceil(20 * F.sqrt(n.cast("double"))).cast("long"))
    start = F.struct(top.alias("term"), top.alias("total"))

    def add(acc, j):  # from the term at m - j + 1 to that at m - j
        term = acc["term"] * (m - j + 1) / (n - m + j)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    tail = F.when(steps < 1, top).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1))), start, add)["total"])
    return F.when(n > 0, F.when(2 * m == n, F.lit(1.0)).otherwise(F.least(2 * tail, F.lit(1.0))))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def softmax(logits, temperature: float = 1.0) -> Column:
    top = F.array_max(col(logits))
    grown = F.transform(col(logits), lambda x: F.exp((x - top) / temperature))
    return F.transform(grown, lambda x: x / F.aggregate(grown, F.lit(0.0), lambda acc, y: acc + y))


def route_logits(logits, bias: dict[int, float] | None = None, force: int | None = None, disabled: list[int] | None = None) -> Column:
    """Logits with additive biases; a forced expert gets +10000, disabled ones -10000."""

    def adjust(x, i):
        for k, b in (bias or {}).items():
            x = x + F.when(i == k, b).otherwise(0.0)
        if force is not None:
            x = x + F.when(i == force, 1e4).otherwise(0.0)
        for k in disabled or []:
            x = x - F.when(i == k, 1e4).otherwise(0.0)
        return x

    return F.transform(col(logits), adjust)


def one_hot_max(values) -> Column:
    """1 at the first largest value, 0 elsewhere."""
    best = F.array_position(col(values), F.array_max(col(values))) - 1
    return F.transform(col(values), lambda x, i: F.when(i == best, 1.0).otherwise(0.0))


def aligned_size(n, unit: int = 64) -> Column:
    return (F.ceil(col(n) / unit) * unit).cast("long")


def line_key(c) -> Column:
    """Line ends as line feeds, outer white space gone."""
    return strip(F.replace(col(c), F.lit("\r\n"), F.lit("\n")))


def sentence_of(columns: list[str], text: str = "text", sentence: str = "sentence", tokens: str = "tokens") -> Column:
    """The first that is not empty: text, sentence, tokens joined by spaces; empty if none is."""
    found = [none_if_empty(strip(F.col(c))) for c in (text, sentence) if c in columns]
    if tokens in columns:
        found.append(none_if_empty(strip(F.array_join(tokens, " "))))
    return F.coalesce(*found, F.lit(""))


def required(c, row_number) -> Column:
    """The stripped value; an empty or missing one is an error that names the row."""
    value = strip(c)
    message = F.concat(F.lit("empty value in row "), col(row_number).cast("string"))
    return F.when(F.coalesce(value, F.lit("")) == "", F.raise_error(message).cast("string")).otherwise(value)


def kept_keys(c, allowed: list[str]) -> Column:
    """The entries of a map whose keys are allowed."""
    return F.map_filter(col(c), lambda k, v: k.isin(allowed))


def dropped_keys(c, allowed: list[str]) -> Column:
    """The keys of a map that are not allowed, in order."""
    return F.array_sort(F.array_except(F.map_keys(col(c)), F.array(*map(F.lit, allowed))))


def expert_index(selector, names: list[str]) -> Column:
    """The number of an expert: digits are a number in range, else the exact name, else the name in any case;
    anything else is an error."""
    text = strip(selector)
    number = F.when(text.rlike("^[0-9]{1,9}$"), text.cast("int"))
    exact = F.array_position(F.array(*map(F.lit, names)), text)
    folded = F.array_position(F.array(*(F.lit(n.lower()) for n in names)), F.lower(text))
    bad = F.raise_error(F.concat(F.lit("no expert "), F.coalesce(text, F.lit("null")))).cast("int")
    inside = F.when(number < len(names), number).otherwise(bad)
    return F.when(number.isNotNull(), inside).when(exact > 0, (exact - 1).cast("int")).when(folded > 0, (folded - 1).cast("int")).otherwise(bad)
