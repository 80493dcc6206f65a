"""Token operators against their libraries, on odd texts and on texts made at random."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphweave.llm import bpe, byte_bpe, common, packing, token_counts, token_files

LIBRARY = {name: Tokenizer.from_file(P.path(name)) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}
RANKS = P.path("byte_bpe_50k.tiktoken")
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
ENCODERS = {name: bpe.library_encoder(P.path(name)) for name in LIBRARY}
SP = byte_bpe.Encoder(RANKS, P.PATTERN)
PIECES = ["a", "b", "The", " ", "\n", "\t", "'", "s", "1", "é", "ß", "😀", "　", "\x1c", "\x85", "!", "́", "中", "\r", "\0", "<|endoftext|>", "can't", "x.", "y,&&&", "III", "ﬁ"]
texts = st.lists(st.sampled_from(PIECES), max_size=30).map("".join) | st.text(max_size=40)


def ids_of(name, text):
    return LIBRARY[name].encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_chunked_encoders_equal_the_libraries(batch):
    for name, encoder in ENCODERS.items():
        assert [x.tolist() for x in bpe.splits(*encoder(batch))] == [ids_of(name, t) for t in batch]
    found, counts = SP.encode(batch)
    assert [x.tolist() for x in bpe.splits(found, counts)] == [TIKTOKEN.encode_ordinary(t) for t in batch]
    assert SP.decode(found, counts) == [t.encode() for t in batch]


def test_every_letter_before_punctuation():
    """Some letters become a letter and a mark under NFC or lower case, and the mark goes with the punctuation."""
    batch = [f"a{c}{end}" for c in map(chr, range(0x110000)) if c.isalpha() for end in (".", ",&&")] + ["AL\u0130. AL\u0130 \u0130(", "\u0915\u0958. \u0958?"]
    for name, encoder in ENCODERS.items():
        wanted = [e.ids for e in LIBRARY[name].encode_batch_fast(batch, add_special_tokens=False)]
        assert [t for t, x, w in zip(batch, bpe.splits(*encoder(batch)), wanted) if x.tolist() != w] == []
    found, counts = SP.encode(batch)
    assert [t for t, x in zip(batch, bpe.splits(found, counts)) if x.tolist() != TIKTOKEN.encode_ordinary(t)] == []
    ranks = bpe.rank_encoder(RANKS, P.PATTERN)
    assert [t for t, x in zip(batch, bpe.splits(*ranks(batch))) if x.tolist() != TIKTOKEN.encode_ordinary(t)] == []


def test_memory_bound_changes_nothing():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(1, 6))) for _ in range(300)]
    small = bpe.Memo(bpe.library_encoder(P.path("byte_bpe_50k.json")).encode, remembered=40)
    for _ in range(20):
        batch = [" ".join(rng.choices(words, k=20)) for _ in range(3)]
        assert [x.tolist() for x in bpe.splits(*small(batch))] == [ids_of("byte_bpe_50k.json", t) for t in batch]


def test_model_needs_ranks_without_gaps():
    with pytest.raises(ValueError):
        byte_bpe.model_bytes({b"a": 0, b"b": 2})


def test_byte_bpe(spark, docs_of, odd):
    rows = docs_of(*odd)
    got = byte_bpe.decoded(byte_bpe.encoded(rows.withColumn("ids", rows.source), RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    key = lambda r: (r[0] is None, r[0], hashlib.sha256(r[1] or b"").hexdigest())
    wanted = [(i, (t or "").encode(), TIKTOKEN.encode_ordinary(t or "")) for i, t in odd]
    assert sorted([(r["doc_id"], bytes(r["bytes"]), list(r["ids"])) for r in got], key=key) == sorted(wanted, key=key)
    assert byte_bpe.encoded(rows.limit(0), RANKS, P.PATTERN).count() == 0
    lost = byte_bpe.decoded(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>"), RANKS, P.PATTERN).first()
    assert bytes(lost["bytes"]) == b""


def test_byte_bpe_query(sf_path, spark, docs_of, odd):
    rows = [r for r in odd if r[0] is not None]
    at = sf_path(documents=docs_of(*rows))
    got = sorted(map(tuple, byte_bpe.op9_byte_bpe(spark, at).collect()))
    wanted = []
    for i, t in rows:
        ids = TIKTOKEN.encode_ordinary(t or "")
        wanted.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(wanted)


def test_token_files(sf_path, spark, docs_of, odd):
    rows = [r for r in odd if r[0] is not None][:-3] + [(7, "w " * 5000), (-4, "first of all")]
    at = sf_path(documents=docs_of(*rows))
    got = {r["doc_id"]: r for r in token_files.op7_token_files(spark, at).collect()}
    before = 0
    for i, t in sorted(rows):
        ids = [*ids_of("word_bpe_49k.json", t or ""), 1]
        assert tuple(got[i])[1:] == (before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)


def test_orc_files_have_what_readers_skip_by(spark, docs_of):
    from pyarrow import orc

    path = common.work_path(spark, "orc-test")
    token_files.write_ids(docs_of(*[(i, f"text {i}") for i in range(3000)], (None, "x")), path, P.path("word_bpe_49k.json"))
    rows = token_files.read_ids(spark, path)
    assert rows.count() == 3001 and rows.where("doc_id = 17").select("n_tokens").first()[0] == len(ids_of("word_bpe_49k.json", "text 17")) + 1
    import glob

    files = sorted(glob.glob(f"{path.removeprefix('file:')}/*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == 3001
    assert all(orc.ORCFile(f).row_index_stride == token_files.INDEX_STRIDE for f in files)
    plan = rows.where("doc_id = 17")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,17)" in plan
    assert sorted(r["doc_id"] for r in token_files.find(spark, path, [5, 2999, 10**9]).collect()) == [5, 2999]
    empty = common.work_path(spark, "orc-empty")
    token_files.write_ids(docs_of().limit(0), empty, P.path("word_bpe_49k.json"))


def check_packing(rows, pieces, capacity):
    """Every document's ids in order, pieces as the contract cuts them, sequences without gaps or overflow."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for i, t in rows:
        ids, at = [*ids_of("byte_bpe_50k.json", t or ""), 0], 0
        own = sorted(by_doc[i], key=lambda p: p["piece"])
        assert [p["piece"] for p in own] == list(range(-(-len(ids) // capacity)))
        for k, p in enumerate(own):
            assert p["start"] == at and (k == 0 or p["length"] == capacity) and p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity


def test_packing(sf_path, spark, docs_of, odd):
    rng = random.Random(5)
    rows = [(k, t) for k, (_, t) in enumerate(odd)] + [(100 + k, "tok " * rng.randint(1, 900)) for k in range(60)] + [(200 + k, "same text here " * 40) for k in range(40)]
    found = packing.op8_best_fit_packing(spark, sf_path(documents=docs_of(*rows))).collect()
    check_packing(rows, found, packing.CAPACITY)
    total = sum(p["length"] for p in found)
    assert len({p["sequence_id"] for p in found}) <= -(-total // packing.CAPACITY) + 1
    assert packing.packed(docs_of().limit(0), P.path("byte_bpe_50k.json")).count() == 0


def fewest(lengths, capacity):
    """The least number of bins, by trying everything."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for b in {x: j for j, x in enumerate(bins)}.values():
            if bins[b] >= lengths[k]:
                put(k + 1, bins[:b] + [bins[b] - lengths[k]] + bins[b + 1 :])
        put(k + 1, [*bins, capacity - lengths[k]])

    put(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=10))
def test_search_finds_the_fewest_bins(lengths):
    counts = {x: lengths.count(x) for x in lengths}
    solution = packing.pack(counts, 20, nodes=3000)
    held = {}
    for filling, times in solution:
        assert sum(x * k for x, k in filling) <= 20
        for x, k in filling:
            held[x] = held.get(x, 0) + k * times
    assert held == counts
    assert packing.lower_bound(counts, 20) <= fewest(lengths, 20) == sum(times for _, times in solution)


def held_in(solution, capacity):
    held = {}
    for filling, times in solution:
        assert sum(x * k for x, k in filling) <= capacity and times > 0
        for x, k in filling:
            held[x] = held.get(x, 0) + k * times
    return held


@pytest.mark.parametrize("counts", [{1: 1100}, {900: 5, 1: 1_000_000}, {2: 3000, 1: 10}, {1500: 3, 2: 2500, 1: 4000}, {x: 40 for x in range(1, 1500)}])
def test_sequences_of_very_many_pieces(counts):
    solution = packing.pack(counts, nodes=50)
    assert held_in(solution, packing.CAPACITY) == counts
    assert sum(times for _, times in solution) >= packing.lower_bound(counts, packing.CAPACITY)
    # asked for even where best fit needs no search
    first = next(iter(packing.fillings(counts, packing.CAPACITY)))
    assert sum(x * k for x, k in first) <= packing.CAPACITY and first[0][0] == max(counts) and all(k <= counts[x] for x, k in first)


def test_search_goes_on_past_the_first_fillings():
    counts = {x: 1 for x in (211, 404, 218, 167, 413, 245, 342, 152, 460, 100, 334, 129, 282, 255)} | {144: 2}
    solution = packing.pack(counts, 1000, nodes=3000)
    assert held_in(solution, 1000) == counts and sum(times for _, times in solution) == 4


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_maximal_fillings_are_all_found(lengths):
    counts = {x: lengths.count(x) for x in sorted(lengths, reverse=True)}
    found = [f for f in packing._maximal(list(counts), list(counts.values()), 20) if f is not None]
    wanted = set()
    for ks in itertools.product(*(range(n + 1) for n in counts.values())):
        room = 20 - sum(x * k for x, k in zip(counts, ks))
        if room >= 0 and all(k == n or x > room for (x, n), k in zip(counts.items(), ks)):
            wanted.add(tuple((x, k) for x, k in zip(counts, ks) if k))
    assert len(found) == len(set(found)) and set(found) == wanted


def test_thousands_of_empty_texts(spark, docs_of, sf_path):
    rows = [(k, None if k % 2 else "") for k in range(5000)]
    found = packing.op8_best_fit_packing(spark, sf_path(documents=docs_of(*rows))).collect()
    check_packing(rows, found, packing.CAPACITY)
    assert len({p["sequence_id"] for p in found}) == 3


def slow_attribution(tokens, text, spans):
    """Token by token and byte by byte."""
    ends = np.cumsum([0] + [len(c.encode()) for c in text])
    owner = {}
    for k, (a, b) in enumerate(spans):
        for byte in range(ends[a], ends[b]):
            owner[byte] = k
    n = len(spans)
    major, start, share, at = [0] * (n + 1), [0] * (n + 1), [0.0] * (n + 1), 0
    for size in tokens:
        own = [owner.get(b, n) for b in range(at, at + size)]
        start[own[0]] += 1
        for k in own:
            share[k] += 1 / size
        runs = []
        for k in own:
            if runs and runs[-1][0] == k:
                runs[-1][1] += 1
            else:
                runs.append([k, 1])
        major[max(runs, key=lambda r: r[1])[0]] += 1
        at += size
    return major, start, share


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab\né😀 ", min_size=1, max_size=30), st.data())
def test_attribution(text, data):
    size = len(text.encode())
    cuts = sorted(data.draw(st.sets(st.integers(1, size), max_size=10)) | {0, size})
    tokens = np.diff(cuts)
    marks = sorted(data.draw(st.lists(st.integers(0, len(text)), max_size=6, unique=True)))
    spans = [(a, b) for a, b in zip(marks[::2], marks[1::2])]
    got = token_counts.attribute(text, tokens, spans)
    wanted = slow_attribution(tokens.tolist(), text, spans)
    assert got[0].tolist() == wanted[0] and got[1].tolist() == wanted[1] and np.allclose(got[2], wanted[2])


def test_token_counts(spark, docs_of, odd):
    found = token_counts.token_counts(docs_of(*odd).withColumn("section", common.held_out()), RANKS, P.PATTERN).collect()
    for i, t in odd:
        own = [r for r in found if r["doc_id"] == i]
        n = len(TIKTOKEN.encode_ordinary(t or ""))
        same = [u or "" for j, u in odd if j == i]
        assert sum(r["n_tokens"] for r in own) == sum(r["n_started"] for r in own) == sum(len(TIKTOKEN.encode_ordinary(u)) for u in same)
        if len(same) == 1:
            assert [(r["start"], r["end"]) for r in sorted(own, key=lambda r: r["section"])] == token_counts.lines(t or "") and abs(sum(r["token_share"] for r in own) - n) < 1e-6
    assert token_counts.token_counts(docs_of().limit(0), RANKS, P.PATTERN).count() == 0


def test_patterns_across_blanks_are_noticed(tmp_path):
    """A vocabulary whose pre-tokens reach over line ends encodes its texts whole, and still equals its library."""
    import json

    own = json.load(open(P.path("byte_bpe_50k.json")))
    own["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"!\n|\w+\s\w+|\s|[^\s]"}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    last = own["model"]["merges"].pop()
    free = own["model"]["vocab"].pop("".join(last if isinstance(last, list) else last.split(" ")))
    own["model"]["vocab"]["!Ċ"] = free
    own["model"]["merges"].append(["!", "Ċ"] if isinstance(last, list) else "! Ċ")
    at = tmp_path / "own.json"
    at.write_text(json.dumps(own))
    library, encoder = Tokenizer.from_file(str(at)), bpe.library_encoder(str(at))
    batch = ["hey!\nyou there", "a b!\n\nc", "one two three", ""]
    assert library.encode("hey!\nyou").ids != [x for c in ("hey!", "\nyou") for x in library.encode(c).ids]
    assert [x.tolist() for x in bpe.splits(*encoder(batch))] == [library.encode(t, add_special_tokens=False).ids for t in batch]


def test_token_count_query(sf_path, spark, docs_of, odd):
    """Byte by byte: a token is the line's that holds most of its bytes, the earlier one on a tie."""
    rows = [*odd, (11, "é\n\n😀x\ny"), (None, "a.\n\n\nb"), (12, " \n" * 40)]
    got = token_counts.op1_token_counts(spark, sf_path(documents=docs_of(*rows).withColumn("section", F.lit(1)))).collect()
    entries = {rank: entry for entry, rank in bpe.read_ranks(RANKS).items()}
    wanted = Counter()
    for i, t in rows:
        t = t or ""
        parts = t.splitlines(keepends=True) if "\n" not in t else [x + "\n" for x in t.split("\n")[:-1]] + ([t.split("\n")[-1]] if t.split("\n")[-1] else [])
        parts = [t] if "\n" not in t else parts
        line_of = [k for k, part in enumerate(parts) for _ in range(len(part.encode()))]
        major, started, at = Counter(), Counter(), 0
        for token in TIKTOKEN.encode_ordinary(t):
            own = Counter(line_of[at : at + len(entries[token])])
            started[line_of[at]] += 1
            major[max(own, key=lambda k: (own[k], -k))] += 1
            at += len(entries[token])
        begin = 0
        for k, part in enumerate(parts):
            wanted[i, k, begin, begin + len(part), major[k], started[k]] += 1
            begin += len(part)
    assert Counter((r["doc_id"], r["section"], r["start"], r["end"], r["n_tokens"], r["n_started"]) for r in got) == wanted


def test_token_file_query_with_odd_ids(sf_path, spark, docs_of, odd):
    """Null ids first, rows of one id by a hash of their text."""
    rows = [*odd, (None, None), (5, "again")]
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    wanted, before = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]])):
        ids = [*ids_of("word_bpe_49k.json", t or ""), 1]
        wanted.append((i, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    got = token_files.op7_token_files(spark, sf_path(documents=docs_of(*rows).withColumn("part", F.lit(1)))).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == wanted


def test_packing_query_with_odd_ids(sf_path, spark, docs_of, odd):
    rows = [*odd, (None, None), (5, "again"), (5, "again")]
    got = packing.op8_best_fit_packing(spark, sf_path(documents=docs_of(*rows).withColumn("length", F.lit(1)))).collect()
    wanted = Counter()
    for i, t in rows:
        ids = [*ids_of("byte_bpe_50k.json", t or ""), 0]
        first = (len(ids) - 1) % packing.CAPACITY + 1
        for k, at in enumerate([0, *range(first, len(ids), packing.CAPACITY)]):
            own = ids[at : at + (packing.CAPACITY if k else first)]
            wanted[i, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == wanted
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    assert all((o == 0) if s != p else (o == po + pl) for (p, po, pl), (s, o, _) in zip([(None, 0, 0), *places], places))
    assert all(o + n <= packing.CAPACITY for _, o, n in places)
