"""Personal data: spans of known kinds, and of terms that would give away what they hide.

Base spans come from one pattern per kind, each over the whole text. What they cover are the
protected entities. A masked entity can still be told from the words near it, if these occur with
it and hardly elsewhere. So, over the whole corpus, the information that a term t near an entity c
gives about it is estimated as

    PMI(c; t) = log2(n(c, t) * N / (n(c) * n(t))),

in documents (copies included); it discloses c if that is at least DISCLOSED of c's own information,
log2(N / n(c)), and if the table of the two in documents is unlikely by chance, by the likelihood
ratio of Dunning (1993), which holds for small counts: G2(c, t) >= UNLIKELY. A term is any word, of
any length, of a text that holds c, however few such texts there are. Each occurrence of a disclosing
term in a document that holds its entity becomes a span of kind "term", and is generalised to what
kind of word it is.

Entities that the same texts hold have the same counts with every term. They are counted as one
class, known by the texts' number and two hashes of their keys, so that a text of a thousand
addresses has one set of pairs and not a thousand.

Everything is DataFrame expressions. Patterns are written so that Java's matcher needs no
backtracking and no recursion, with the same matches as the plain forms in PLAIN.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, filtered_early, once

KINDS = ("email", "ip", "card", "phone")
#: The definitions, as any regular expression library reads them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same for Java: possessive, and tried only where a run of the first class begins or the last
#: match has ended. A single digit, which the plain form of "card" passes over, is dropped later.
_JAVA = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": PLAIN["phone"],
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
#: Only texts that hold this can hold the kind.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: A term: letters with their marks, of any length.
TERM = r"[\p{L}\p{M}]+"
DISCLOSED = 0.8
#: G2 of a probability of 0.001 by chance (chi squared, one degree of freedom).
UNLIKELY = 10.83

_SPAN = "struct<start:int,end:int,said:string>"


def _prefixes(steps: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Inclusive sums (or whatever ``op`` makes of numbers from 0) of a non-empty array, in blocks of about the root of its length."""
    total = lambda xs: F.aggregate(xs, F.lit(0), op)

    def blocks(s: Column, n: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / n).cast("int")), lambda k: total(F.slice(s, k * n + 1, n)))
        bases = lambda sums: F.transform(sums, lambda _, k: total(F.slice(sums, F.lit(1), k)))
        return once(once(sums, bases), lambda base: F.transform(
            s, lambda _, k: op(F.element_at(base, (F.floor(k / n) + 1).cast("int")), total(F.slice(s, (k - k % n) + 1, k % n + 1)))
        ))

    return once(steps, lambda s: once(F.ceil(F.sqrt(F.size(s).cast("double"))).cast("int"), lambda n: blocks(s, n)))


def find(text: Column, pattern: str, needs: str | None = None) -> Column:
    """Matches of ``pattern`` in order: array of (start, end, said), code points, end exclusive."""
    none = F.array().cast(f"array<{_SPAN}>")

    def of(said: Column) -> Column:
        def place(between: Column) -> Column:
            steps = F.transform(said, lambda m, k: F.length(between[k]) + F.when(k > 0, F.length(said[k - 1])).otherwise(0))
            return once(_prefixes(steps, lambda a, b: a + b), lambda starts: F.transform(
                said, lambda m, k: F.struct(starts[k].alias("start"), (starts[k] + F.length(m)).alias("end"), m.alias("said"))
            ))

        return F.when(F.size(said) > 0, once(F.split(text, pattern, -1), place)).otherwise(none)

    found = once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)
    return F.when(F.contains(text, F.lit(needs)), found).otherwise(none) if needs else found


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The sum of digits, every second one from the right doubled and its digits added, is a multiple of 10."""

    def value(k: Column) -> Column:
        d = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int")
        return F.when(k % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, k: a + value(k)) % 10 == 0


def _valid(kind: str, said: Column) -> Column:
    if kind == "ip":
        return said.rlike(_IP)
    if kind == "card":
        return once(_digits(said), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(said)).between(8, 15)
    return F.lit(True)


def _keep_valid(kind: str, spans: Column) -> Column:
    return spans if kind == "email" else F.filter(spans, lambda x: _valid(kind, x["said"]))


def base_spans(text: Column) -> Column:
    """struct of an array of (start, end, said) for each of KINDS."""
    kinds = []
    for kind in KINDS:
        spans = find(text, _JAVA[kind], _NEEDS[kind])
        kinds.append(_keep_valid(kind, spans).alias(kind))
    return F.struct(*kinds)


def _written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def _entity(kind: str, said: Column) -> Column:
    plain = F.lower(said) if kind == "email" else said if kind == "ip" else _digits(said)
    return F.concat(F.lit(kind + ":"), plain)


def _as_entities(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _entity(kind, x["said"]).alias("said")))


def _clear(words: Column, spans: Column) -> Column:
    """The words, in order and apart from each other, that no span overlaps: one merge of both by place.

    A span that starts before a word ends overlaps it if it ends after the word starts, so the
    furthest end of the spans before the word's end decides.
    """
    of_span = lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("kind"), b["end"].alias("reach"), F.lit(0).alias("start"), F.lit("").alias("said"))
    of_word = lambda x: F.struct(x["end"].alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("reach"), x["start"].alias("start"), x["said"].alias("said"))

    def merged(events: Column) -> Column:
        furthest = _prefixes(F.transform(events, lambda e: e["reach"]), lambda a, b: F.greatest(a, b))
        seen = F.zip_with(events, furthest, lambda e, far: F.struct(e.alias("e"), far.alias("far")))
        free = F.filter(seen, lambda y: (y["e"]["kind"] == 0) & (y["far"] <= y["e"]["start"]))
        return F.transform(free, lambda y: F.struct(y["e"]["start"].alias("start"), y["e"]["at"].alias("end"), y["e"]["said"].alias("said")))

    return F.when(F.size(words) > 0, once(F.sort_array(F.concat(F.transform(words, of_word), F.transform(spans, of_span))), merged)).otherwise(
        F.array().cast(f"array<{_SPAN}>")
    )


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: ``id_col``, email, ip, card, phone, term (arrays of start, end, said), and text if asked for.

    A null text counts as empty. Repeated rows get the same spans each, whatever their ids; null
    ids stay. Other columns play no part. An empty table gives an empty one. A very long text is
    read whole; work on it grows with its length to the power 1.5 at most, and with its words
    times the classes of its entities.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("i"), text.alias("t")).withColumn("b", base_spans(F.col("t")))
    some = F.size("b.email") + F.size("b.ip") + F.size("b.card") + F.size("b.phone") > 0
    based = scratch.cut(
        rows.select("i", F.when(some, F.sha2("t", 256)).alias("key"), "b", (F.col("t") if with_text else F.when(some, F.col("t"))).alias("t")), "base"
    )
    # texts that hold an entity, each once, with the number of documents that say them
    texts = based.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("t").alias("t"), F.first("b").alias("b"))
    entities = F.concat(*(_as_entities(k, F.col("b")[k]) for k in KINDS))
    texts = texts.withColumn("f", entities)
    spans = _terms(docs, text, texts, scratch)
    # documents without an entity have no key to join by
    none = based.where("key is null").withColumn("term", F.lit(None).cast(f"array<{_SPAN}>"))
    out = based.where("key is not null").join(spans, "key", "left").unionByName(none)
    return out.select(
        F.col("i").alias(id_col), *(F.col("b")[k].alias(k) for k in KINDS),
        F.coalesce("term", F.array().cast(f"array<{_SPAN}>")).alias("term"), *([F.col("t").alias(text_col)] if with_text else []),
    )


def _terms(docs: DataFrame, text: Column, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, term): every occurrence of the disclosing terms in texts (key, n, t, f) that hold their entity."""
    words = F.transform(find(F.col("t"), TERM), lambda x: x.withField("said", F.lower(x["said"])))
    entities = F.array_distinct(F.transform("f", lambda x: x["said"]))
    texts = scratch.cut(texts.select("key", "n", entities.alias("cs"), _clear(words, F.col("f")).alias("x")), "texts")
    mentions = texts.select("key", "n", F.explode("cs").alias("c"))
    # written, so that a join with it may split an entity that many texts hold
    alike = scratch.cut(mentions.groupBy("c").agg(
        F.sum("n").alias("n_c"), F.count(F.lit(1)).alias("m"),
        F.bit_xor(F.xxhash64("key")).alias("h"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("h2"),
    ).select("c", F.struct("n_c", "m", "h", "h2").alias("class")), "alike")
    of_text = mentions.select("key", "c").join(alike, "c").groupBy("key").agg(F.collect_set("class").alias("classes"))
    texts = scratch.cut(texts.drop("cs").join(of_text, "key"), "classed")

    terms = F.array_distinct(F.transform("x", lambda x: x["said"]))
    pairs = texts.select("key", "n", terms.alias("terms"), F.explode("classes").alias("class")).select("key", "n", "class", F.explode("terms").alias("term"))
    counts = scratch.cut(pairs.groupBy("class", "term").agg(F.sum("n").alias("n_ct")), "pairs")
    flagged = scratch.cut(_disclosing(docs, text, counts, scratch), "flagged")
    with filtered_early(docs.sparkSession):
        mine = scratch.cut(pairs.select("key", "class", "term").join(flagged, ["class", "term"]).select("key", "term").distinct(), "mine")
        held = texts.select("key", F.explode("x").alias("x")).select("key", F.col("x.said").alias("term"), "x")
        found = held.join(mine, ["key", "term"]).groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("term"))
        return scratch.cut(found, "terms")


def _disclosing(docs: DataFrame, text: Column, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(class, term) of ``counts`` (class, term, n_ct) at or over both thresholds."""
    held = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))
    # documents that hold each term, over the whole corpus
    n_t = scratch.cut(docs.select(F.explode(held).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), "n_t")
    log = lambda x: F.log2(x.cast("double"))
    total = docs.select(F.count(F.lit(1)).alias("n_all"))
    joined = counts.withColumn("n_c", F.col("class.n_c")).join(n_t, "term").join(F.broadcast(total))  # one row
    pmi = log(F.col("n_ct")) + log(F.col("n_all")) - log(F.col("n_c")) - log(F.col("n_t"))
    own = log(F.col("n_all")) - log(F.col("n_c"))
    return joined.where((own > 0) & (pmi >= DISCLOSED * own) & (_g2() >= UNLIKELY)).select("class", "term")


def _g2() -> Column:
    """The likelihood ratio of the columns n_ct, n_c, n_t and n_all."""
    n_ct, n_c, n_t, n_all = (F.col(k).cast("double") for k in ("n_ct", "n_c", "n_t", "n_all"))
    cell = lambda seen, a, b: F.when(seen > 0, seen * F.log(seen * n_all / (a * b))).otherwise(0.0)
    return 2 * (
        cell(n_ct, n_c, n_t) + cell(n_c - n_ct, n_c, n_all - n_t)
        + cell(n_t - n_ct, n_all - n_c, n_t) + cell(n_all - n_c - n_t + n_ct, n_all - n_c, n_all - n_t)
    )


def written_spans(kinds: tuple[str, ...] = (*KINDS, "term")) -> Column:
    """kind:start:end of all spans, by kind and start, joined by commas."""
    return F.array_join(F.concat(*(_written(k, F.col(k)) for k in kinds)), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``text_col`` with entities replaced by their kind in brackets, and terms generalised.

    A disclosing term becomes [NAME] if capitalised, else [WORD]. Where spans overlap the first stands.
    """
    found = find_pii(docs, id_col, text_col, with_text=True)
    def of_kind(k: str) -> Column:
        return F.transform(F.col(k), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(k).alias("kind")))

    spans = F.array_sort(F.concat(*map(of_kind, (*KINDS, "term"))))
    text = F.col(text_col)

    def step(done: Column, x: Column) -> Column:
        first = F.substring(text, x["start"] + 1, F.lit(1))
        label = F.when(x["kind"] != "term", F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).when(F.lower(first) != first, F.lit("[NAME]")).otherwise(F.lit("[WORD]"))
        more = F.struct(F.concat(done["out"], F.substring(text, done["at"] + 1, x["start"] - done["at"]), label).alias("out"), x["end"].alias("at"))
        return F.when(x["start"] >= done["at"], more).otherwise(done)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return found.select(id_col, F.aggregate(spans, start, step, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text)))).alias(text_col))
