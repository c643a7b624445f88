"""Mixing, token files, packing, WARC, the Jaccard join and the license scan against plain Python."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomlake.llm import jaccard_join, license_scan, warc
from fathomlake.llm.mixing import emit, mix, targets
from fathomlake.llm.packing import pack_documents, sum_of_squares
from fathomlake.llm.queries import tokenizer
from fathomlake.llm.token_files import Reader, Writer, bits_for, pack, read_token_files, unpack, write_token_files
from fathomlake.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared_out(sizes: dict, weights, share=150, most=2):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    closed, left = {}, sum(sizes.values()) * share / 100
    while True:
        rest = [s for s in order if s not in closed]
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] >= most * sizes[s]]
        if not over:
            return closed | {s: level * weight[s] for s in rest}
        for s in over:
            closed[s] = most * sizes[s]
            left -= closed[s]


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 5, None: 7, "é": 0}, {"a": 3}, {None: 0}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(frame).collect()}
    want = shared_out(sizes, (3, 1, 2))
    assert got == {s: pytest.approx(t) for s, t in want.items()}


def test_mix_is_near_its_targets_and_repeats(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * int(math.exp(rng.uniform(0, 7)))), rng.choice("aaabcd") if k % 50 else None) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.copies <= 2 and r.taken == r.copies * r.size
    for some in by.values():
        assert some[0].source_size == sum(r.size for r in some)
        assert abs(sum(r.taken for r in some) - some[0].target) <= max(r.size for r in some) + 0.01 * some[0].target
    again = {(r.doc_id, r.copies) for r in mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}
    assert emit(mix(docs), docs.columns).count() == sum(r.copies for r in got)


def test_mix_of_odd_rows(documents_on_disk, empty):
    got = mix(documents_on_disk)
    assert got.count() == documents_on_disk.count() and set(documents_on_disk.columns) <= set(got.columns)
    assert all(r.taken == 0 for r in got.where("size = 0").collect())
    assert mix(empty).count() == 0


ODD = ["", "a", "a b", "a  b", "a\nb", " a", "a ", "\n", "a\n\nb c", "x\ty z", "a \nb", "don't we'll it's\nI'm", "<|endoftext|> a<|endoftext|>b",
       "é é ́x ß Σας ΑΣ\nfoo", "1 22 a1b2 $5.00 (x) ...\n--- 你好 世界 🙂 a🙂b", "a\x1cb c", "a᠎ b c", "\0a \0 b\0", "The. end, of.\nThe", "wörter, Ärger."]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    by_words, whole = Encoder(tokenizer(name), room=50), Encoder(tokenizer(name), by_words=False)
    assert by_words.encode(ODD, 7) == whole.encode(ODD, 7)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abT '\n.,1é$ ́S") for _ in range(rng.randrange(40))) for _ in range(5000)]
    assert by_words.encode(texts) == whole.encode(texts)


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_bit_packing(tmp_path, bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 20_000).astype("<u4")
    assert (unpack(pack(ids[:1000], bits), bits, 1000) == ids[:1000]).all()
    cuts = [0, 0, 5, 5000, 5000, 20_000]
    writer = Writer(f"file://{tmp_path}/x.tok", bits)
    for k in range(5):
        writer.add(None if k == 2 else k, ids[cuts[k] : cuts[k + 1]])
    writer.close()
    reader = Reader(f"file://{tmp_path}/x.tok")
    assert (reader.ids(4090, 12_300) == ids[4090:12_300]).all() and (reader.document(3) == ids[5000:5000]).all()
    for k, (doc_id, first, n, parts) in enumerate(reader):
        assert (doc_id, first, n) == (None if k == 2 else k, cuts[k], cuts[k + 1] - cuts[k])
        assert b"".join(p.tobytes() for p in parts) == ids[cuts[k] : cuts[k + 1]].tobytes()
    reader.close()


def test_fewest_bits():
    assert [bits_for(v) for v in (1, 2, 3, 256, 257, 50_257, 65_537)] == [1, 1, 2, 8, 9, 16, 17]


def encoded(rows, name, end):
    library = Encoder(tokenizer(name), by_words=False)
    return library.encode([t or "" for t in rows], end)


def test_token_files(documents_on_disk, empty):
    name = tokenizer("byte_bpe_50k.json")
    index = write_token_files(documents_on_disk, name, 2)
    got = sorted(read_token_files(index).collect(), key=lambda r: r.start)
    rows = documents_on_disk.select("doc_id", "text").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    want = Counter((r.doc_id, len(x) // 4, zlib.crc32(x)) for r, x in zip(rows, encoded([r.text for r in rows], "byte_bpe_50k.json", 2), strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert read_token_files(write_token_files(empty, name, 2)).count() == 0


def test_packing(documents_on_disk, empty):
    name = tokenizer("word_bpe_49k.json")
    got = pack_documents(documents_on_disk, name, 1).collect()
    rows = documents_on_disk.select("doc_id", "text").collect()
    want = Counter()
    for r, x in zip(rows, encoded([r.text for r in rows], "word_bpe_49k.json", 1), strict=True):
        for piece, at in enumerate(range(0, len(x) // 4, 4096)):
            part = x[4 * at : 4 * (at + 4096)]
            want[r.doc_id, piece, at, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= 4096
    assert pack_documents(empty, name).count() == 0


def slow_sum_of_squares(lengths, room):
    gaps, out = [], []
    for n in lengths:
        options = [(None, room - n)] + [(k, g - n) for k, g in enumerate(gaps) if g >= n]

        def cost(option):
            after = list(gaps) + [option[1]] if option[0] is None else [option[1] if k == option[0] else g for k, g in enumerate(gaps)]  # noqa: B023
            return sum(c * c for g, c in Counter(after).items() if g)

        least = min(cost(o) for o in options)
        best = min((o for o in options if cost(o) == least), key=lambda o: (o[0] is None, o[1]))
        out.append(least)
        if best[0] is None:
            gaps.append(best[1])
        else:
            gaps[best[0]] = best[1]
    return out, len(gaps)


def test_sum_of_squares_places_as_defined():
    rng = random.Random(4)
    for _ in range(60):
        lengths = [rng.randint(1, 20) for _ in range(40)]
        bins, offsets = sum_of_squares(np.array(lengths), 20)
        sums, gaps = [], {}
        for n, b, o in zip(lengths, bins, offsets, strict=True):
            assert gaps.get(b, 20) == 20 - o and o + n <= 20
            gaps[b] = 20 - o - n
            sums.append(sum(c * c for g, c in Counter(gaps.values()).items() if g))
        assert (sums, len(gaps)) == slow_sum_of_squares(lengths, 20)


def test_packing_is_close_to_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.sort(np.minimum(4096, rng.lognormal(6, 1.2, 5000).astype(int) + 1))[::-1]
    bins, _ = sum_of_squares(lengths, 4096)
    assert bins.max() + 1 <= math.ceil(lengths.sum() / 4096) * 1.002 + 1


PAGES = [(1, "u1", "x" * 2000), (2, "u 2\n", "x" * 2000), (3, None, "small"), (4, "u4", "small"), (5, "u5", None), (None, "u6", "x" * 2000), (7, "u7", "é" * 600),
         (9, "r", "y" * 1000), (9, "r", "y" * 1000), (8, "r", "y" * 1000), (10, "long", "z\r\n\r\nWARC/1.1 " * 200_000), (None, "n", "q" * 1500), (None, "n", "q" * 1500)]


def test_warc_round_trip(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(2).write.parquet(path)
    index = warc.write_warc(spark.read.parquet(path))
    got = warc.read_warc(index, keep_payload=True).collect()
    assert len(got) == len(PAGES)
    groups = defaultdict(list)
    for i, _, html in PAGES:
        groups[html or ""].append(i)
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha1(r.payload.encode()).hexdigest() == r.payload_digest and len(r.payload.encode()) == r.payload_bytes and r.refers_to is None
    for html, ids in groups.items():
        digest = hashlib.sha1(html.encode()).hexdigest()
        mine = [r for r in got if r.payload_digest == digest]
        assert Counter(r.page_id for r in mine) == Counter(ids)
        best = max((i for i in ids if i is not None), default=None)
        if len(html.encode()) >= 1000:
            response = [r for r in mine if r.record_type == "response"]
            assert len(response) == 1 and response[0].page_id == best and all(r.refers_to == best for r in mine if r.record_type == "revisit")
        else:
            assert all(r.record_type == "response" for r in mine)
    heads = []
    for r in index.collect():
        system, place = warc.file_system(r.file)
        with system.open_input_file(place) as f:
            heads.append(warc.parse_record(f.read_at(r.length, r.offset))[0])
    ids = {h["WARC-Record-ID"]: h for h in heads}
    assert len(ids) == len(heads)
    for h in heads:
        if h["WARC-Type"] == "revisit":
            origin = ids[h["WARC-Refers-To"]]
            assert origin["WARC-Type"] == "response" and origin["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
    one = warc.read_warc(index.where("page_id = 3")).collect()
    assert [(r.page_id, r.record_type) for r in one] == [(3, "response")]
    files = [f.file for f in index.select("file").distinct().collect()]
    whole = b"".join(gzip.decompress(open(f.removeprefix("file://").removeprefix("file:"), "rb").read()) for f in files)
    assert whole.count(b"WARC-Record-ID: ") == len(PAGES)  # an ordinary reader sees every record


def test_warc_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(empty)).count() == 0


def slow_components(rows, size, percent):
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return [(i, len(s), min((x for x in least[find(k)] if x is not None), default=None) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_copies(seed: int) -> list[tuple[int, str]]:
    """Families of copies with edits around the threshold, a shared passage, and chains."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 6, 12, 30, 80, 200]))]
        if rng.random() < 0.5:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        text = base
        for _ in range(rng.randint(1, 8)):
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
            text = list(rng.choice([base, text]))
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                at = rng.randrange(len(text))
                text[at : at + rng.choice([0, 1])] = [word()] * rng.choice([0, 1, 2])
                text = text or [word()]
    return rows


@pytest.mark.parametrize(("size", "percent", "fan"), [(4, 85, 8), (5, 80, 1), (2, 90, 1)])
def test_jaccard_components(spark, tmp_path, size, percent, fan):
    rows = near_copies(size) + [(5000, None), (5001, ""), (5002, " \n"), (5003, "One two"), (5004, "one\tTWO"), (None, "one two"), (5003, "One two")]
    path = str(tmp_path / "d")
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, root string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    got = jaccard_join.jaccard_components(docs, size=size, percent=percent, fan=fan).collect()
    want = slow_components(rows, size, percent)
    assert Counter(map(tuple, got)) == Counter(want)
    if fan == 8:
        kept = jaccard_join.near_dedup(docs, size=size, percent=percent)
        assert kept.columns == docs.columns
        held = [r.doc_id for r in kept.collect()]
        assert Counter(held) == Counter({c for _, n, c in want if n}) + Counter(i for i, n, _ in want if not n)


@pytest.mark.parametrize("fan", [1, 8])
def test_links_between_texts_far_from_the_main_component(spark, tmp_path, fan):
    """Large families with all degrees of change, some of whose members have copies of their own."""
    rng = random.Random(fan)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))

    def changed(text: list[str], share: float) -> list[str]:
        return [word() if rng.random() < share else w for w in text]

    rows = []
    for _ in range(2):
        base = [word() for _ in range(150)]
        for k in range(110):
            text = changed(base, rng.uniform(0, 0.12))
            rows.append((len(rows), " ".join(text)))
            if k % 3 == 0:
                text = changed(changed(base, 0.06), 0) if k % 2 else text
                rows += [(len(rows) + j, " ".join(changed(text, rng.choice([0.005, 0.01, 0.03])))) for j in range(rng.randint(1, 4))]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    got = jaccard_join.jaccard_components(spark.read.parquet(path), size=4, percent=85, fan=fan).collect()
    want = slow_components(rows, 4, 85)
    assert Counter(map(tuple, got)) == Counter(want)
    sizes = Counter(c for _, _, c in want)
    assert sum(1 for n in sizes.values() if 1 < n < 12) > 10  # small components beside the main one


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_linked_sets_share_a_signature(percent):
    enum, rng = jaccard_join.PartEnum(percent), np.random.default_rng(percent)
    for _ in range(1500):
        a = np.unique(rng.integers(0, 1 << 63, int(np.exp(rng.uniform(0, 7))), dtype=np.uint64))
        changes = int(rng.uniform(0, 1.2) * len(a) * (100 - percent) / 100)
        gone = int(rng.integers(0, changes + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, changes - gone, dtype=np.uint64)]))
        if jaccard_join.linked(a, b, percent):
            assert len(np.intersect1d(enum.signatures(a), enum.signatures(b)))


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_sketches_hide_no_link(percent):
    rng = np.random.default_rng(percent)
    sets = []
    for _ in range(60):
        a = np.unique(rng.integers(0, 1 << 63, int(np.exp(rng.uniform(0, 7))), dtype=np.uint64))
        sets.append(a)
        for share in rng.uniform(0, 0.5, 3):
            fresh = rng.integers(0, 1 << 63, int(share * len(a) * rng.uniform(0, 1)), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([rng.permutation(a)[int(share * len(a)) :], fresh])))
    sets = [s for s in sets if len(s)]
    comps = rng.integers(0, 100, len(sets))
    sizes, sketches = np.array([len(s) for s in sets]), [jaccard_join.sketch(s, percent) for s in sets]
    assert len({len(s) for s in sketches}) > 2
    kept = jaccard_join.with_partner(sizes, sketches, comps, percent)
    some = rng.permutation(len(sets))
    assert (jaccard_join.with_partner(sizes[some], [sketches[k] for k in some], comps[some], percent) == kept[some]).all()
    links = [(a, b) for a in range(len(sets)) for b in range(a) if comps[a] != comps[b] and jaccard_join.linked(sets[a], sets[b], percent)]
    assert len(links) > 20 and all(kept[a] and kept[b] for a, b in links)
    assert kept.sum() < len(sets) * 0.95
    a, b = sets[0], sets[4]
    x, y = (s.reshape(1, -1) for s in sketches[0:5:4])
    least = min(x.size, y.size)
    assert np.bitwise_count(jaccard_join.folded(x, least) ^ jaccard_join.folded(y, least)).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("sketched", [1024, 3])
def test_relatives_below_the_threshold_are_not_measured(spark, tmp_path, monkeypatch, sketched):
    """Families whose members share signatures, few of them linked; the same result where groups stay whole."""
    rng = random.Random(sketched)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(300)]
        for k in range(20):
            text = [word() if rng.random() < 0.1 else w for w in base]
            rows.append((len(rows), " ".join(text)))
            if k % 10 == 0:
                rows.append((len(rows), " ".join([*text[:-1], word()])))
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    measured, before = [], jaccard_join._measured
    monkeypatch.setattr(jaccard_join, "_measured", lambda groups, *rest: (measured.append(groups.select("id").distinct().count()), before(groups, *rest))[1])
    monkeypatch.setattr(jaccard_join, "SKETCHED", sketched)
    got = jaccard_join.jaccard_components(spark.read.parquet(path), size=5, percent=80).collect()
    assert Counter(map(tuple, got)) == Counter(slow_components(rows, 5, 80))
    assert (measured[0] < 40) == (sketched > 3)


def test_sketches_meet_in_tiles(spark, tmp_path, monkeypatch):
    """Groups of more members than meet in one place: relatives leave them, and no link is lost."""
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    rows = []
    for _ in range(3):
        base = [word() for _ in range(300)]
        for k in range(40):
            text = [word() if rng.random() < 0.1 else w for w in base]
            rows.append((len(rows), " ".join(text)))
            if k % 10 == 0:
                rows.append((len(rows), " ".join([*text[:-1], word()])))
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    measured, before = [], jaccard_join._measured
    monkeypatch.setattr(jaccard_join, "_measured", lambda groups, *rest: (measured.append(groups.select("id").distinct().count()), before(groups, *rest))[1])
    monkeypatch.setattr(jaccard_join, "SKETCHED", 16)
    got = jaccard_join.jaccard_components(spark.read.parquet(path), size=5, percent=80).collect()
    want = slow_components(rows, 5, 80)
    assert Counter(map(tuple, got)) == Counter(want) and max(Counter(c for _, _, c in want).values()) > 1
    assert measured[0] < 40


def test_members_joined_by_their_centre_have_no_entries(spark, tmp_path, monkeypatch):
    """A large family of copies and a few pairs of relatives: only the pairs are still to be looked up."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    base, rows, far = [word() for _ in range(300)], [], set()
    for _ in range(60):
        rows.append((len(rows), " ".join(word() if rng.random() < 0.01 else w for w in base)))
    for _ in range(4):
        text = [word() if rng.random() < 0.12 else w for w in base]
        for _ in range(2):
            far.add(len(rows))
            rows.append((len(rows), " ".join([*text[:-1], word()])))
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    seen, before = [], jaccard_join._entries
    monkeypatch.setattr(jaccard_join, "_entries", lambda members, percent: (seen.append(members.select("id").distinct().count()), before(members, percent))[1])
    got = jaccard_join.jaccard_components(spark.read.parquet(path), size=5, percent=80).collect()
    assert Counter(map(tuple, got)) == Counter(slow_components(rows, 5, 80))
    assert max(seen) <= len(far)


def test_jaccard_of_nothing(empty):
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_of_odd_rows(documents_on_disk):
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(documents_on_disk).collect()}
    assert {(1, 1), (2, 1), (None, 1), (3, 3), (4, 4), (6, 6), (8, 8), (-9, -9)} <= got


def five_word_runs(text: str) -> list[tuple]:
    words = re.findall(r"\w+", text.lower())
    return [tuple(words[k : k + 5]) for k in range(len(words) - 4)]


def held_by_windows(text: str, templates) -> dict[str, int]:
    """The most shingles of each template in a window of twice its length, rounded up to a power of 2, that begins every such length."""
    runs, want = five_word_runs(text), {}
    for name, template in templates:
        wanted, c = set(five_word_runs(template)), 1
        while c < len(wanted):
            c *= 2
        most = max((len(wanted.intersection(runs[k : k + 2 * c])) for k in range(0, len(runs), c)), default=0)
        if most >= 0.8 * len(wanted):
            want[name] = most
    return want


def test_bands_find_what_windows_hold():
    """Recall of the bands against all windows and templates, with edits down to the threshold and 300 templates."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    templates = [(f"t{k}", " ".join(rng.choices(words, k=rng.choice([6, 12, 25, 60, 150])))) for k in range(300)]
    scanner, wanted, found = license_scan.Scanner(templates), 0, 0
    for _ in range(400):
        text = rng.choice(templates)[1].split()
        for _ in range(rng.randint(0, max(1, len(text) // 25))):
            text[rng.randrange(len(text))] = "edited"
        text = " ".join([*rng.choices(words, k=rng.randint(0, 200)), *text, *rng.choices(words, k=rng.randint(0, 200))])
        want, got = held_by_windows(text, templates), {x[0] for x in scanner.scan(text)}
        assert got <= set(want)
        wanted, found = wanted + len(want), found + len(got)
    assert wanted > 200 and found >= 0.999 * wanted


def test_more_templates_than_one_pass_takes(spark, monkeypatch):
    rows = [(k, f"x {text} y") for k, (_, text) in enumerate(license_scan.ALL)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    scan = lambda: Counter(map(tuple, license_scan.scan_licenses(frame, license_scan.ALL, short=True).collect()))
    whole = scan()
    monkeypatch.setattr(license_scan, "TOGETHER", 7)
    assert scan() == whole


def test_license_scan(spark, documents_on_disk, empty):
    rng = random.Random(9)
    filler = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "licensed", "under", "the"]) for _ in range(n))
    rows = []
    for k in range(120):
        name, text = rng.choice(license_scan.TEMPLATES)
        words = text.split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            words[rng.randrange(len(words))] = "edited"
        rows.append((k, f"{filler(rng.randint(0, 90))}\n{' '.join(words)}\n{filler(rng.randint(0, 90))}"))
    rows += [(500, filler(70_000) + " " + license_scan.TEMPLATES[7][1]), (501, None), (502, ""), (503, "Released under the")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("matched", F.lit("x"))
    got = defaultdict(dict)
    for r in license_scan.scan_licenses(frame).collect():
        got[r.doc_id][r.license_id] = r.matched
        words = re.findall(r"\w+", dict(rows)[r.doc_id].lower())
        assert 0 <= r.start_word < r.end_word <= len(words) and r.containment == r.matched / r.shingles >= 0.8
    for i, text in rows:
        assert got[i] == held_by_windows(text or "", license_scan.TEMPLATES)
    assert got[500] and license_scan.scan_licenses(documents_on_disk).count() == 0 == license_scan.scan_licenses(empty).count()
    with pytest.raises(ValueError, match="fewer"):
        license_scan.Scanner([("short", "MIT License")])


def test_license_lines_of_few_words(spark):
    rows = [(1, "some text\nAll rights reserved.\nmore"), (2, "SPDX-License-Identifier: MIT"), (3, "all rights are reserved"), (4, "small rights reserved")]
    rows += [(10 + k, f"words before {text} words after") for k, (_, text) in enumerate(license_scan.ALL)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license_id): (r.start_word, r.end_word) for r in license_scan.scan_licenses(frame, license_scan.ALL, short=True).collect()}
    assert got[1, "all-rights-reserved"] == (2, 5) and got[2, "MIT-SPDX"] == (0, 4) and not {k for k in got if k[0] in (3, 4)}
    for k, (name, text) in enumerate(license_scan.ALL):
        assert got[10 + k, name] == (2, 2 + len(re.findall(r"\w+", text)))
    assert len({name for name, _ in license_scan.ALL}) == len(license_scan.ALL)


def test_license_scan_gives_every_place():
    """Copies apart, copies that follow each other, edited ones, and copies across blocks."""
    scanner = license_scan.Scanner(license_scan.ALL, short=True)
    rng = random.Random(4)
    for name, text in license_scan.ALL:
        said = re.findall(r"\w+", text.lower())
        for gaps in ([0, 0, 0], [3, 0, 40], [rng.randint(0, 99), 1, 2], [32_760, 32_760, 5]):
            words, want = [], []
            for k, gap in enumerate(gaps):
                words += [f"w{rng.randrange(10**6)}" for _ in range(gap)]
                want.append((len(words), len(words) + len(said)))
                words += said
                if k == 1 and len(said) > 60:
                    words[-30] = "edited"
            got = [(r[4], r[5]) for r in scanner.scan(" ".join(words)) if r[0] == name]
            assert sorted(got) == want, (name, gaps)


def test_record_bytes_are_stable():
    data = warc.record(1, "http://a", b"x", 1, hashlib.sha1(b"x").hexdigest(), None)
    assert data == warc.record(1, "http://a", b"x", 1, hashlib.sha1(b"x").hexdigest(), None) and struct.unpack("<H", data[:2])[0] == 0x8B1F
