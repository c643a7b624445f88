"""The pipeline against a brute-force version of its stages on a small table."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
from fathomlake.llm.mixing import SEED
from fathomlake.llm.quality_rules import RULES
from tests.llm.test_free import WORD, encoded, shared_out, slow_components
from tests.llm.test_native import counts


def documents() -> list[tuple]:
    rng = random.Random(8)
    common = "the of and to in is la de der und que el".split()
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for k in range(160):
        words = [word() for _ in range(rng.choice([5, 30, 60, 200]))]
        if k % 9 == 0:
            words = [w + "###" for w in words]
        if k % 11 == 0:
            words = (words[:10] * 30)[:100]
        rows.append((k, " ".join(words), "en", rng.choice(["a", "b", "c", None]), 1))
    for k in range(160, 200):
        _, text, *rest = rng.choice(rows)
        words = text.split()
        if k % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words), *rest))
    return rows + [(900, None, None, None, None), (901, "", "en", "a", 0), (5, rows[5][1], "en", "b", 1), (None, rows[7][1] + " tail", "en", "c", 1)]


def keeps(text) -> bool:
    c = counts(text)
    base = c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]
    low = any(r.least is not None and 100 * c[r.count] < r.least * c[r.per] for r in RULES)
    return not (base or low or any(r.most is not None and 100 * c[r.count] > r.most * c[r.per] for r in RULES))


def mixed(rows: list[tuple]) -> list[tuple]:
    size = {r: len(WORD.findall(r[1] or "")) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    aims = shared_out({s: sum(size[r] for r in some) for s, some in by.items()}, (3, 1, 2))
    md5 = lambda *parts: hashlib.md5("|".join(parts).encode()).hexdigest()
    out = []
    for source, some in by.items():
        total = sum(size[r] for r in some)
        start = int(md5(SEED, "n" if source is None else "s" + source)[:8], 16) / 2**32
        mark = lambda r: md5(SEED, "~" if r[0] is None else str(r[0]))
        order = sorted(some, key=lambda r: (len(str(size[r])), str(size[r]).ljust(2, "0")[:2], mark(r)[:2], mark(r), size[r]))
        for k, r in enumerate(order):
            rate = aims[source] / total if total else 0
            out += [r] * (min(2, math.floor(start + rate * (k + 1)) - math.floor(start + rate * k)) if size[r] else 0)
    return out


def test_stages(spark, tmp_path):
    rows = documents()
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    docs, stages = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        stages.append([tuple(r) for r in docs.collect()])
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    after = [r for r in rows if keeps(r[1])]
    assert Counter(stages[0]) == Counter(after) and len(after) < len(rows)
    best: dict[str, tuple] = {}
    for r in after:
        if r[1] not in best or (r[0] is not None and (best[r[1]][0] is None or r[0] > best[r[1]][0])):
            best[r[1]] = r
    assert Counter((r[0], r[1]) for r in stages[1]) == Counter((r[0], r[1]) for r in best.values())
    after = stages[1]
    component = slow_components([(r[0], r[1]) for r in after], 5, 80)
    assert Counter(r[0] for r in stages[2]) == Counter({c for _, _, c in component}) and len(stages[2]) < len(after)
    assert Counter(stages[3]) == Counter(mixed(stages[2]))
    lengths = Counter()
    for r, ids in zip(stages[3], encoded([r[1] for r in stages[3]], "word_bpe_49k.json", 1), strict=True):
        lengths[r[0]] += len(ids) // 4
    packed = Counter()
    for doc_id, _, _, length, _, _, _ in stages[4]:
        packed[doc_id] += length
    assert packed == lengths
    used = Counter()
    for *_, length, _, sequence, _ in stages[4]:
        used[sequence] += length
    assert max(used.values()) <= 4096 and len(used) <= math.ceil(sum(used.values()) / 4096) + 1
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.run(spark, path).collect()) == Counter(r[:5] for r in stages[4])
