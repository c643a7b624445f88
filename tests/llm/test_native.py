"""Quality rules, chat formatting, personal data and exact dedup against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from fathomlake.llm import chat_format, pii
from fathomlake.llm.exact_dedup import exact_dedup, exact_groups
from fathomlake.llm.oracles import ORACLES
from fathomlake.llm.quality_rules import RULES, STOP_WORDS, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text: str | None) -> dict:
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    places = defaultdict(list)
    for k in range(len(words) - 7):
        places[tuple(words[k : k + 8])].append(k)
    covered = {j for v in places.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
    stop = {w for s in STOP_WORDS for w in (s, s.capitalize())}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_stop_words": sum(w in stop for w in words),
    }


def test_quality_counts(spark, odd_documents, empty):
    got = quality(odd_documents, keep_columns=["doc_id", "text"]).collect()
    assert len(got) == odd_documents.count()
    for row in got:
        want = counts(row.text)
        assert {k: row[k] for k in want} == want
        assert row.base_failed == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
        broken = [r.name for r in RULES if (r.least is not None and 100 * want[r.count] < r.least * want[r.per]) or (r.most is not None and 100 * want[r.count] > r.most * want[r.per])]
        assert row.failed == broken and row.kept == (not row.base_failed and not broken)
    assert quality(empty).count() == 0


def test_quality_of_random_repeats(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + rng.choice(["", "\n", "\nx y\nx y"]) for _ in range(300)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in quality(frame).collect():
        assert row.n_repeat_words == counts(row.text)["n_repeat_words"] and row.n_dup_lines == counts(row.text)["n_dup_lines"]


def test_quality_is_one_projection(spark, odd_documents):
    plan = quality(odd_documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("digest", [None, lambda t: F.substring(F.md5(t), 1, 1)])
def test_exact_groups(documents_on_disk, digest):
    """Also with a digest of one character, where only the texts tell groups apart."""
    got = exact_groups(documents_on_disk, **({"digest": digest} if digest else {})).collect()
    rows = [(r.doc_id, r.text or "") for r in documents_on_disk.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = Counter((i, max((x for x in groups[t] if x is not None), default=None), len(groups[t])) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_keeps_whole_rows(documents_on_disk, empty):
    got = exact_dedup(documents_on_disk)
    assert got.columns == documents_on_disk.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter([2, None, 4, 5, 6, 7, 8, -9])
    assert exact_groups(empty).count() == exact_dedup(empty).count() == 0


ALPHABET = ["#", "##", "###", "\\", "</turn>", "</turn", "<", "### Assistant: ", ": ", "a", "\n", "/", "é", "🙂", ""]


def test_chat_round_trip(spark):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, n)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "User", "=user", some(3), None]), rng.choice([some(9), None])) for c in range(400) for t in range(rng.randint(1, 4))]
    rows += [(9000, 1, "user", r"\### Assistant: </turn> ok"), (9000, 1, "assistant", "same turn"), (None, None, "user", "no conversation"), (9001, 0, "assistant", "long " * 50_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t if t is not None else -1, r or "", x or ""))
    got = chat_format.format_chat(turns.withColumn("formatted", F.lit("x"))).collect()
    assert len(got) == len(by)
    for row in got:
        want = sorted(by[row.conv_id])
        assert [(t.role, t.text) for t in row.turns] == [(r, x) for _, r, x in want]
        assert row.formatted.count("</turn>\n") == len(want)
        learnt = [x for _, r, x in want if r == "assistant"]
        spans = [row.formatted[s.start : s.end] for s in row.loss_spans]
        assert [re.sub(r"(?s)\\(.)", r"\1", s) if "\\" in s else s for s in spans] == learnt


def test_chat_leaves_plain_text_alone(spark):
    turns = spark.createDataFrame([(1, 0, "user", "C# and a/b"), (1, 1, "assistant", "ends with \\")], "conv_id long, turn long, role string, text string")
    assert chat_format.format_chat(turns).first().formatted == "### User: C# and a/b</turn>\n### Assistant: ends with \\</turn>\n"


def test_chat_of_nothing(spark):
    assert chat_format.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_parser_refuses_what_is_not_a_sentence(spark):
    bad = ["", "x", "### User: a", "### User: a</turn>", "### User: a</turn>\nx", "### : a</turn>\n", "### User a</turn>\n", "### User: ### b</turn>\n"]
    rows = spark.createDataFrame([(b,) for b in bad], "f string").select(chat_format.parse(F.col("f")).alias("p")).collect()
    assert all(r.p is None for r in rows)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text: str) -> dict[str, list[tuple[int, int]]]:
    out = {}
    for kind in pii.KINDS:
        out[kind] = []
        for m in re.finditer(pii.PLAIN[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 8 <= len(d) <= 15,
            }[kind]()
            if ok:
                out[kind].append(m.span())
    return out


def test_pii_base_spans_of_random_texts(spark):
    rng = random.Random(11)
    parts = ["a@b.co", "@", ".", "x_y%z", "+1 (555) 010-9999", "+", "4111 1111 1111 1111", "4111111111111111", "1", "-", " ", "255.1.2.3", "256.1.1.1", "001.002.003.004", "é", "(", "9", "\n", "🙂", "a.b@c.d.e"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    texts += ["1 " * 30_000, "1" * 30_000, "a" * 50_000 + "@b.c", "a@b.c " * 3000, "1." * 20_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").select("doc_id", pii.base_spans(F.col("t")).alias("b")).collect()
    for row in rows:
        got = {k: [(x.start, x.end) for x in row.b[k]] for k in pii.KINDS}
        assert got == base(texts[row.doc_id]), texts[row.doc_id][:200]


def test_pii_terms(spark, tmp_path):
    """Terms of entities, by counts in plain Python and by SQL."""
    rng = random.Random(2)
    names = [f"{c}{c}arlo".replace("0", "") for c in "bdfgklmnprstvz"]
    mails = [f"user{k}@mail.example" for k in range(6)]
    rows = []
    for k in range(400):
        words = [rng.choice(["common", "words", "everywhere", "tiny", "of"]) for _ in range(20)]
        if k % 3 == 0:
            m = rng.randrange(6)
            words.insert(10, mails[m])
            words.insert(9, names[m].capitalize())
            if rng.random() < 0.2:
                words.insert(3, names[(m + 1) % 6])
        rows.append((k, " ".join(words)))
    rows += [(1000, rows[0][1]), (1000, rows[0][1]), (None, rows[3][1]), (1001, None), (1002, "")]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    term = re.compile(r"[^\W\d_]+")
    held, n_c, n_ct, n_t = {}, Counter(), Counter(), Counter()
    for _, text in rows:
        text = text or ""
        n_t.update({t.lower() for t in term.findall(text)})
        found = [(s, e, f"{k}:{text[s:e].lower()}") for k, spans in base(text).items() for s, e in spans]
        words = [(m.start(), m.end(), m[0].lower()) for m in term.finditer(text)]
        words = [w for w in words if not any(s < w[1] and w[0] < e for s, e, _ in found)]
        held[text] = ({c for _, _, c in found}, words)
        n_c.update(held[text][0])
        n_ct.update({(c, t) for c in held[text][0] for _, _, t in words})

    def discloses(pair):
        a, c, t, n = n_ct[pair], n_c[pair[0]], n_t[pair[1]], len(rows)
        table = [(a, c, t), (c - a, c, n - t), (t - a, n - c, t), (n - c - t + a, n - c, n - t)]
        g2 = 2 * sum(x * math.log(x * n / (r * k)) for x, r, k in table if x)
        return n > c and math.log2(a * n / (c * t)) >= pii.DISCLOSED * math.log2(n / c) and g2 >= pii.UNLIKELY

    flagged = {p for p in n_ct if discloses(p)}
    assert flagged
    got = pii.find_pii(docs, with_text=True).collect()
    assert len(got) == len(rows)
    for row in got:
        mine, words = held[row.text]
        assert [(x.start, x.end, x.said) for x in row.term] == [w for w in words if any((c, w[2]) in flagged for c in mine)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    sql = con.execute(ORACLES["op9_pii"]).fetchall()
    columns = [d[0] for d in con.description]
    assert Counter(r[columns.index("spans")] for r in sql) == Counter(r.s for r in pii.find_pii(docs).select(pii.written_spans().alias("s")).collect())
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "[NAME]" in clean[0] and "[EMAIL]" in clean[0] and "@" not in "".join(clean.values())
    assert clean[1] == rows[1][1]  # a clean document is left alone


def test_pii_terms_of_few_texts(spark):
    """Entities in one text, and in copies of one text, get terms; words of other documents do not."""
    rows = [(k, "common words everywhere") for k in range(300)]
    rows += [(300, "common Quillfeather one@mail.example words"), (301, "common words Brackenridge two@mail.example")]
    rows += [(k, "everywhere Thistlewood three@mail.example common") for k in range(302, 340)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r.doc_id: [x.said for x in r.term] for r in pii.find_pii(docs).collect() if r.term}
    want = {300: ["quillfeather"], 301: ["brackenridge"]} | {k: ["thistlewood"] for k in range(302, 340)}
    assert terms == want


def test_pii_terms_of_whole_texts(spark):
    """Terms far from their entity, repeated, and short ones; not those of a base span or of documents without the entity."""
    filler = "common words everywhere " * 60
    rows = [(k, filler) for k in range(600)]
    rows += [(600, f"Quillfeather {filler}one@mail.example {filler}Bo, Quillfeather"), (601, f"{filler}李 two@mail.example"), (602, f"Bo {filler}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.term) for r in pii.find_pii(docs, with_text=True).collect()}
    assert {i: [x.said for x in terms] for i, (_, terms) in got.items() if terms} == {600: ["quillfeather", "bo", "quillfeather"], 601: ["李"]}
    assert all(text[x.start : x.end].lower() == x.said for text, terms in got.values() for x in terms)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Quillfeather" not in clean[600] and clean[600].endswith("[NAME], [NAME]") and clean[0] == filler


def test_pii_of_many_entities_in_one_text(spark):
    """Addresses of one text are one class; words and spans are merged, not compared with each other."""
    mails = " ".join(f"to u{k}@mail.example" for k in range(20_000))
    rows = [(k, "to common words everywhere") for k in range(600)] + [(600, f"{mails} Quillfeather"), (601, "to u7@mail.example Brackenridge")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (len(r.email), [x.said for x in r.term]) for r in pii.find_pii(docs).collect()}
    assert time.time() - began < 120
    assert got[600] == (20_000, ["quillfeather"]) and got[601] == (1, ["brackenridge"]) and got[0] == (0, [])


@pytest.mark.parametrize("seed", range(3))
def test_pii_words_clear_of_spans(spark, seed):
    rng = random.Random(seed)
    cases = []
    for k in range(200):
        words, at = [], 0
        for _ in range(rng.randint(0, 12)):
            at += rng.randint(1, 4)
            words.append((at, at + rng.randint(1, 5), "w"))
            at = words[-1][1]
        starts = [rng.randint(0, 50) for _ in range(rng.randint(0, 5))]
        cases.append((k, words, [(s, s + rng.randint(1, 15), "s") for s in starts]))
    span = "array<struct<start:int,end:int,said:string>>"
    rows = spark.createDataFrame(cases, f"k int, w {span}, s {span}").select("k", pii._clear(F.col("w"), F.col("s")).alias("free")).collect()
    for row in rows:
        _, words, spans = cases[row.k]
        assert [tuple(x) for x in row.free] == [w for w in words if not any(s < w[1] and w[0] < e for s, e, _ in spans)]


def test_pii_of_odd_rows(spark, documents_on_disk, empty):
    assert pii.find_pii(documents_on_disk).count() == documents_on_disk.count()
    assert pii.find_pii(empty).count() == 0


def test_chat_query_reads_the_loss_mask(spark):
    """A missing, shifted or doubled span changes the loss columns."""
    from fathomlake.llm.queries import _chat

    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", r"\### a </turn> b"), (1, 2, "assistant", "plain")]
    found = chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    learnt = "".join(r[3] for r in rows[1:])
    right = _chat(found).first()
    assert (right.loss_chars, right.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    moved = F.transform("loss_spans", lambda x: F.struct((x["start"] + 1).alias("start"), (x["end"] + 1).alias("end")))
    for wrong in (F.slice("loss_spans", 1, 1), moved, F.concat("loss_spans", "loss_spans")):
        assert _chat(found.withColumn("loss_spans", wrong)).first().loss_sha256 != right.loss_sha256


def test_digests_are_of_utf8(spark):
    row = exact_groups(spark.createDataFrame([(1, "é")], "doc_id long, text string")).first()
    assert row.text_digest == hashlib.sha256("é".encode()).hexdigest()


def test_rows_are_known_by_content(spark, tmp_path):
    """File splits that change between two jobs change nothing."""
    path = str(tmp_path / "d")
    rows = [(k, f"text number {k % 500} " * 20, f"c{k}") for k in range(20_000)]
    spark.createDataFrame(rows, "doc_id long, text string, extra string").repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        found = exact_groups(docs)
        whole = exact_dedup(docs)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert sorted(r.doc_id for r in found.where("kept").collect()) == list(range(19_500, 20_000))
        assert sorted(whole.collect()) == sorted(rows[19_500:])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_columns_named_like_results_stay(spark, documents_on_disk, empty):
    from fathomlake.llm.mixing import mixed_rows
    from fathomlake.llm.quality_rules import keep

    docs = documents_on_disk
    for name in ("__counts", "__row", "__src", "__class", "__mark", "__salt", "__size", "row", "own", "counts", "times"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    rows = Counter(map(tuple, docs.collect()))
    for stage in (keep, exact_dedup, mixed_rows):
        found = stage(docs)
        assert found.columns == docs.columns and {tuple(r) for r in found.collect()} <= set(rows)
        assert stage(empty).count() == 0
    assert exact_dedup(docs).count() == len({r.text or "" for r in docs.select("text").collect()}) and keep(docs).count() >= 3
