"""Personal data by bootstrapped contextual extraction, with DataFrame functions alone.

Formats of four kinds (``BASE``) find plain e-mail addresses, IP addresses, card and phone numbers. The same
finds are the *seeds* of the bootstrap: the words around a seed are its lexical patterns, and looser formats
(``CANDIDATE``) give instances that no base format takes: numbers without a country code, ``name (at) host``,
cards with a wrong check digit, IPv6. Patterns and instances form a bipartite graph of narrow hashed rows.
In each round a pattern's confidence in a kind is the score that its instances have as that kind, against
all it holds, and an unknown instance's score is the chance that not all of its patterns are wrong. Instances
that reach ``ACCEPT`` are spans wherever they stand, added to the base spans.

Whole texts are read once. A text stays in its row; what is shuffled are hashes of patterns and instances,
counted per task first. Scores are whole thousandths, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repovigil.functions.skew import salted_lookup
from repovigil.session import written

ROUNDS = 3
#: A pattern counts from this many instances on, and from this confidence on; so does an instance's score.
LEAST_MASS, CONFIDENT, ACCEPT = 3, 600, 600
#: Thousandths that an unknown instance of a kind counts against the patterns it has.
DOUBT = 250
KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)

# The base formats. Runs are possessive and begin where a run begins or the last find ended, so
# no run is read from each of its places; the finds are those of the plain formats.
_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
BASE = {
    EMAIL: _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[ -]?[0-9])++",
    PHONE: r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a format to have a valid find in it at all.
_SIGN = {
    EMAIL: lambda t: t.contains("@"),
    IP: lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    CARD: lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    PHONE: lambda t: t.contains("+"),
}
_FREE = r"(?<![A-Za-z0-9])"
#: Seeds and instances in one pass; the first alternative that fits wins.
CANDIDATE = "|".join(
    [
        _LOCAL + r"(?:@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
        r"| ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)*+"
        r"| at [A-Za-z0-9-]++(?:(?: dot |\.)[A-Za-z0-9-]++)++)",
        BASE[PHONE],
        _FREE + r"[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![A-Za-z0-9:])",
        _FREE + r"[0-9]++(?:\[?\.\]?[0-9]++){3}(?![A-Za-z0-9])",
        _FREE + r"(?:\([0-9]{1,5}\)[ .-]?)?[0-9](?:[ .-]?[0-9])++(?![A-Za-z0-9])",
    ]
)
_CANDIDATE_SIGN = (
    r"@|[\[(]at[\])]| at [A-Za-z0-9-]++(?: dot |\.)[A-Za-z0-9]|[0-9A-Fa-f]:{1,2}[0-9A-Fa-f]"
    r"|[0-9]\[?\.\]?[0-9]|[0-9](?:[ .()-]{0,2}[0-9]){6}"
)
#: Marks put around finds, and what stands for them where a text holds them itself.
_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"
_BLOCK = 256
_SPAN = "array<struct<kind:int,start:int,stop:int>>"
_FIND = "array<struct<kind:int,start:int,stop:int,seed:boolean,instance:bigint,patterns:array<bigint>>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, for use inside and around lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(numbers: Column) -> Column:
    """Running sums of an array, in blocks, so that no long array grows by one item at a time."""

    def sums(items: Column) -> Column:
        grown = F.aggregate(
            items, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        )
        return F.slice(grown, F.lit(2), F.size(items))

    def whole(items: Column) -> Column:
        parts = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int")),
            lambda b: sums(F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK))),
        )
        add = lambda blocks, upto: F.flatten(
            F.transform(blocks, lambda block, k: F.transform(block, lambda v: v + F.get(upto, k) - F.element_at(block, -1)))
        )
        last = lambda blocks: sums(F.transform(blocks, lambda block: F.element_at(block, -1)))
        return _let(parts, lambda blocks: _let(last(blocks), lambda upto: add(blocks, upto)))

    return _let(numbers, whole)


def _finds(text: Column, pattern: str, make: Callable[..., Column], keep: Callable[[Column], Column]) -> Column:
    """``make(find, start, stop, gap before, gap after)`` of each find of a pattern that ``keep`` accepts.

    Marks are put around all finds in one pass; the text cut at the marks has gaps and finds in turn,
    and the running sums of their lengths are the places.
    """
    marked = F.regexp_replace(text, f"({pattern})", f"{_OPEN}$1{_CLOSE}")
    parts = F.split(marked, f"[{_OPEN}{_CLOSE}]", -1)

    def places(parts: Column, ends: Column) -> Column:
        odd = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k % 2 == 1)
        kept = F.filter(odd, lambda k: keep(F.get(parts, k)))
        return F.transform(
            kept,
            lambda k: make(F.get(parts, k), F.get(ends, k - 1), F.get(ends, k), F.get(parts, k - 1), F.get(parts, k + 1)),
        )

    ends = lambda parts: _running(F.transform(parts, F.length))
    return _let(parts, lambda p: _let(ends(p), lambda e: places(p, e)))


def _digits(find: Column) -> Column:
    return F.regexp_replace(find, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of 13 to 19 digits is right."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    weighted = F.transform(values, lambda v, k: F.when(k % 2 == 0, v).when(v < 5, 2 * v).otherwise(2 * v - 9))
    total = F.aggregate(weighted, F.lit(0), lambda acc, v: acc + v)
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def _valid_ip(find: Column) -> Column:
    return find.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")


_VALID = {
    EMAIL: lambda find: F.lit(True),
    IP: _valid_ip,
    CARD: lambda find: _luhn(_digits(find)),
    PHONE: lambda find: F.length(_digits(find)).between(9, 15),
}


def _base_spans(text: Column, kind: int) -> Column:
    make = lambda find, start, stop, before, after: F.struct(
        F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop")
    )
    found = _finds(text, BASE[kind], make, _VALID[kind])
    return F.when(_SIGN[kind](text), found.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _kind(find: Column) -> Column:
    """The kind that a find of ``CANDIDATE`` may be of; null if it has too few or too many digits."""
    digits = F.length(_digits(find))
    return (
        F.when(find.rlike(r"@|[\[(]at[\])]| at "), EMAIL)
        .when(find.startswith("+"), F.when(digits.between(7, 15), PHONE))
        .when(find.contains(":") | find.rlike(r"^[0-9]+(?:\[?\.\]?[0-9]+){3}$"), IP)
        .when(digits.between(13, 19), CARD)
        .when(digits.between(7, 12), PHONE)
    )


def _is_seed(find: Column) -> Column:
    return (
        find.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$")
        | (find.startswith("+") & F.length(_digits(find)).between(9, 15))
        | _valid_ip(find)
        | (find.rlike("^[0-9](?:[ -]?[0-9])++$") & _luhn(_digits(find)))
    )


def _near_words(gap: Column) -> Column:
    """Words of a stretch of text: letters and digits, lower-cased, digits alike."""
    plain = F.regexp_replace(F.lower(gap), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.regexp_replace(plain, "[0-9]+", "0"), " "), lambda w: w != "")


def _patterns(before: Column, after: Column) -> Column:
    """Hashes of the two words before, the two after, and one of each side."""

    def of(left: Column, right: Column) -> Column:
        two = lambda side, words: F.when(F.size(words) == 2, F.xxhash64(F.lit(side), F.array_join(words, " ")))
        both = F.when(
            (F.size(left) > 0) & (F.size(right) > 0),
            F.xxhash64(F.lit("both"), F.concat_ws(" ", F.element_at(left, -1), F.get(right, F.lit(0)))),
        )
        return F.array_compact(F.array(two("before", left), two("after", right), both))

    last = _let(_near_words(F.substring(before, -80, 80)), lambda w: F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2)))
    first = F.slice(_near_words(F.substring(after, 1, 80)), 1, 2)
    return _let(last, lambda left: _let(first, lambda right: of(left, right)))


def _instance(find: Column, kind: Column) -> Column:
    plain = F.when(kind.isin(CARD, PHONE), _digits(find)).otherwise(F.lower(find))
    return F.xxhash64(kind, plain)


def _instances(text: Column) -> Column:
    def make(find, start, stop, before, after):
        return _let(
            _kind(find),
            lambda kind: F.struct(
                kind.alias("kind"), start.alias("start"), stop.alias("stop"), _is_seed(find).alias("seed"),
                _instance(find, kind).alias("instance"), _patterns(before, after).alias("patterns"),
            ),
        )

    found = _finds(text, CANDIDATE, make, lambda find: _kind(find).isNotNull())
    return F.when(text.rlike(_CANDIDATE_SIGN), found.cast(_FIND)).otherwise(F.array().cast(_FIND))


def find_instances(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, base, finds), one row per row of ``docs``, written once.

    ``base`` are the spans of the base formats by kind and start, ``finds`` the seeds and unknown
    instances with the hashes of instance and patterns. A null text is empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = text.contains(_OPEN) | text.contains(_CLOSE)
    text = F.when(marked, F.translate(text, _OPEN + _CLOSE, _OTHER * 2)).otherwise(text)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    base = F.concat(*[_base_spans(F.col("text"), kind) for kind in range(4)])
    found = rows.select("doc_id", base.alias("base"), _instances(F.col("text")).alias("finds"))
    return written(found.withColumn("row", F.monotonically_increasing_id()), "pii-finds")


def _stats(patterns: DataFrame, scores: DataFrame | None, unknown: DataFrame) -> DataFrame:
    """(pattern, kind, weight): confident patterns and what they say for an instance of that kind.

    ``weight`` is -ln(1 - confidence) in millionths.
    """
    if scores is None:
        gained = patterns.withColumn("gained", F.lit(0).cast("bigint"))
    else:
        known = salted_lookup(unknown, scores, "instance", ["pattern"])
        sums = known.groupBy("pattern", "kind").agg(F.sum("score").alias("gained"))
        gained = patterns.join(sums, ["pattern", "kind"], "left").na.fill(0, ["gained"])
    mass = F.col("seeds") * 1000 + F.col("gained")
    doubt = F.expr(f"({DOUBT} * (1000 * unknown - gained)) div 1000")
    against = F.col("others") * 1000 + doubt + 1000
    confidence = F.expr("(1000 * mass) div (mass + against)")
    return (
        gained.withColumns({"mass": mass, "against": against})
        .withColumn("confidence", F.least(confidence, F.lit(999)))
        .where((F.col("mass") >= LEAST_MASS * 1000) & (F.col("confidence") >= CONFIDENT))
        .select("pattern", "kind", F.floor(-1e6 * F.log(1 - F.col("confidence") / 1000)).alias("weight"))
    )


def accepted_instances(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, score): unknown instances that the pattern graph takes for personal data.

    ``score`` is in thousandths. Equal finds in one context count once, however many documents repeat them.
    """
    edges = (
        found.select(F.explode("finds").alias("f"))
        .select("f.kind", "f.seed", "f.instance", F.explode("f.patterns").alias("pattern"))
        .groupBy("pattern", "instance", "kind").agg(F.max("seed").alias("seed"))
    )
    edges = written(edges, "pii-edges")
    # a pattern without unknown instances finds none; the others' counts stay as they are in all rounds
    count = lambda kind, seed: F.count_if((F.col("kind") == kind) & (F.col("seed") == seed))
    per_pattern = edges.groupBy("pattern").agg(
        F.array(*[count(k, True) for k in range(4)]).alias("seeds"),
        F.array(*[count(k, False) for k in range(4)]).alias("unknown"),
        F.count_if("seed").alias("all_seeds"),
    )
    patterns = per_pattern.select("pattern", "seeds", "unknown", "all_seeds", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("kind"))
    patterns = patterns.select(
        "pattern", "kind", F.get("seeds", F.col("kind")).alias("seeds"), F.get("unknown", F.col("kind")).alias("unknown"),
        (F.col("all_seeds") - F.get("seeds", F.col("kind"))).alias("others"),
    ).where("unknown > 0")
    patterns = written(patterns, "pii-patterns")
    unknown = edges.where(~F.col("seed")).select("pattern", "instance", "kind")
    scores = None
    for _ in range(rounds):
        sure = _stats(patterns, scores, unknown).withColumnRenamed("kind", "of")
        voted = salted_lookup(unknown, sure, "pattern", ["instance"]).where(F.col("kind") == F.col("of"))
        total = voted.groupBy("instance").agg(F.sum("weight").alias("weight"))
        score = F.floor(1000 * (1 - F.exp(-F.col("weight") / 1e6)) + 1e-6)
        scores = written(total.select("instance", score.alias("score")), "pii-scores")
    return scores.where(F.col("score") >= ACCEPT) if rounds else edges.select("instance", F.lit(0).cast("bigint").alias("score")).limit(0)


def find_personal_data(
    docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, base, added), one row per row of ``docs``; both are arrays of (kind, start, stop).

    Places are code points, stops exclusive, kinds places in ``KINDS``. ``base`` holds the finds of the base
    formats, ``added`` those of the pattern graph that share no place with a base span; both by kind, then
    start. Null and empty texts have none. Copies have the same spans; repeated rows stay.
    """
    found = find_instances(docs, id_col, text_col)
    accepted = accepted_instances(found, rounds)
    single = found.where(F.size("finds") > 0).select("row", F.explode(F.filter("finds", lambda f: ~f["seed"])).alias("f"))
    hits = salted_lookup(single.select("row", "f.instance", "f.kind", "f.start", "f.stop"), accepted, "instance", ["row"])
    per_row = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "stop"))).alias("added"))
    joined = found.select("row", "doc_id", "base").join(per_row, "row", "left")
    apart = F.filter(
        "added", lambda a: ~F.exists("base", lambda b: (b["start"] < a["stop"]) & (a["start"] < b["stop"]))
    )
    return joined.select("doc_id", "base", F.coalesce(apart, F.array().cast(_SPAN)).alias("added"))


def report(personal: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans as text."""
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ","
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return personal.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
