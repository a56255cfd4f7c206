"""Conversation trie, filter audit and packing against brute force, with odd rows and at the limits."""

import collections
import hashlib
import itertools
import random
import re
import zlib
from bisect import bisect_left, insort

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import best_fit_packing, conversation_trie, filter_audit
from tests.test_catalog import rows

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"

# ---- trie ----


def trie(conversations):
    """Every node by its whole sequence of turns."""
    turns = collections.defaultdict(list)
    for c, turn, role, text in conversations:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c in turns:
        h, rest = zlib.crc32(str(c).encode()) % 9, int(abs(c) % 5) * (1 if c > 0 else -1)
        built[c] = tuple(turns.get(c - rest, [])[:h] + turns[c][h:])
    members = collections.defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children, leaves, saved = collections.Counter(k[:-1] for k in members if k), collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    ends = lambda k, m: ",".join(map(str, sorted(c for c in m if built[c] == k)))
    return sorted((min(m), len(k), -10**9 if not k else min(members[k[:-1]]), len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends(k, m).encode()).hexdigest()) for k, m in members.items())


def found(spark, conversations, schema=CONVERSATIONS):
    got = conversation_trie.digest(spark.createDataFrame(conversations, schema)).collect()
    return sorted((x.conv_id, x.depth, -10**9 if x.parent_conv_id is None else x.parent_conv_id, *x[3:]) for x in got)


def test_trie_equals_sql(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from read_parquet('{path}')")
    assert rows(conversation_trie.digest(spark.read.parquet(path)).toPandas()) == rows(c.execute(conversation_trie.ORACLE).df())


def test_trie_of_odd_rows(spark, monkeypatch):
    """Blocks of the chain, runs and chunks so small that all of them are crossed."""
    for name, n in (("CHAIN", 4), ("RUN", 3), ("CHUNK", 2)):
        monkeypatch.setattr(conversation_trie, name, n)
    r = random.Random(3)
    said = [(None, None), ("user", "a"), ("user", "é"), ("assistant", "a"), ("user", "")]
    data = [(c, t if t % 7 else None, *r.choice(said)) for c in range(-12, 30) if c % 11 for t in range(r.choice([1, 2, 5, 9, 40, 90]))]
    data += [(c, t, "user", "same") for c in range(100, 140) for t in range(12)]  # many equal ones
    data += data[:50]  # repeated rows
    data += [(None, 1, "user", "lost"), (7001, None, None, None), (7003, 5, "user", "base absent")]
    assert found(spark, data) == trie(data)
    wide = [(*x, x[0], "z") for x in data if x[0] == 3]
    assert found(spark, wide, CONVERSATIONS + ", depth bigint, digest string") == trie([x[:4] for x in wide])
    assert found(spark, []) == []


def test_trie_of_one_long_conversation(spark):
    """Two conversations share thousands of turns: rows stay linear in the turns."""
    data = [(c, t, "user", str(t % 10)) for c in (5, 6) for t in range(3000)] + [(c, 0, "user", "x") for c in (11, 12)]
    got = found(spark, data)
    top = next(x for x in got if x[1] == 0)
    assert top[3] == 4 and len(got) == len({(x[0], x[1]) for x in got}) and max(x[1] for x in got) == 3000
    assert top[6] == trie_saved(data) and sum(x[5] for x in got if x[1] == 0) == sum(not x[4] for x in got)


def trie_saved(data):
    turns = collections.defaultdict(list)
    for c, _, role, text in data:
        turns[c].append((role, text))
    built = []
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built.append(turns.get(c - c % 5, [])[:h] + turns[c][h:])
    seen, total = set(), 0
    for t in built:
        state = hashlib.md5()
        for role, text in t:
            state.update(f"{role}|{text}|".encode())
            key = state.digest()
            total += len(text.encode()) if key in seen else 0
            seen.add(key)
    return total


# ---- audit ----


def audit(docs, labels):
    fails = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        repeated = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        bad = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), repeated)
        say = lambda k: i is not None and any(x[0] == i and x[k] == 1 for x in labels)  # noqa: B023, E731
        fails.append((source or "", {c for c, b in zip("ABCDE", bad, strict=True) if b}, say(1), say(2)))
    out, shapley = [], collections.Counter()
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, c in enumerate(order):
                alive = [f for f in own if not f[1] & set(order[:k])]
                gone = [f for f in alive if c in f[1]]
                shapley[part, c] += len(gone)
                out.append([part, order, k + 1, len(alive) - len(gone), len(gone), sum(c in f[1] for f in own) - len(gone), sum(f[1] == {c} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)])
    return sorted((*x, shapley[x[0], x[1][x[2] - 1]]) for x in out)


def audited(spark, docs, labels, schema="doc_id bigint, text string, source string"):
    got = filter_audit.digest(spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    return sorted(map(tuple, got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()))


def test_audit_equals_sql(spark):
    c, d = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    got = filter_audit.digest(*[spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels")])
    assert rows(got.toPandas()) == rows(c.execute(filter_audit.ORACLE).df())


def test_audit_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "INDEX_ROWS", 100)
    r = random.Random(5)
    bits = ["word", "Éa", "LOUD NOISE", "#", "a b c", "\t", "\xa0", " ".join(f"w{i}" for i in range(60)), "x " * 70]
    texts = ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(1, 5))) for _ in range(40)] + [None, "", "same"]
    docs = [(r.choice([None, *range(150)]), r.choice(texts), r.choice([None, "", "s", "s", "t"])) for _ in range(400)]
    docs += [(i, "same", "s") for i in range(300, 500)] + docs[:20]
    labels = [(r.choice([None, *range(150)]), r.choice([None, 0, 1, 2]), r.choice([None, 0, 1])) for _ in range(200)]
    assert audited(spark, docs, labels) == audit(docs, labels)
    assert audited(spark, [(*x, 1) for x in docs[:30]], [], "doc_id bigint, text string, source string, part int") == audit(docs[:30], [])
    assert audited(spark, [], labels) == []


def test_flags_of_a_long_text():
    text = b"abc def\n" * 400_000
    assert filter_audit.flags(text) == 0b0010 and filter_audit.flags(text + b"#") == 0b1010


# ---- packing ----


def best_fit(lengths, capacity):
    """Best-fit decreasing, a document at a time."""
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect_left(rooms, x)
        n += i == len(rooms)
        insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - x)
    return n


@pytest.mark.parametrize("capacity", [5, 16, 64, 1024])
def test_plan_is_best_fit(capacity):
    r = random.Random(capacity)
    for _ in range(20):
        counts = {x: r.randrange(1, r.choice([2, 5, 60])) for x in r.sample(range(1, capacity + 1), min(capacity, r.randrange(1, 200)))}
        slots, held, ranks = best_fit_packing.plan(counts, capacity), collections.defaultdict(list), collections.defaultdict(list)
        for length, start, stop, sequence, each, offset in slots:
            ranks[length] += range(start, stop)
            for k in range(stop - start):
                held[sequence + k // each].append((offset + k % each * length, length))
        assert all(sorted(ranks[x]) == list(range(n)) for x, n in counts.items())
        for spans in held.values():
            ends = [0, *itertools.accumulate(x for _, x in sorted(spans))]
            assert [o for o, _ in sorted(spans)] == ends[:-1] and ends[-1] <= capacity
        assert len(held) == best_fit([x for x, n in counts.items() for _ in range(n)], capacity)
    many = best_fit_packing.plan({x: 10**9 + x for x in range(1, capacity + 1)}, capacity)
    assert len(many) < 3 * capacity * 45


def test_words_give_the_tokenizers_ids(monkeypatch):
    whole, words, r = Tokenizer.from_file(PATH), best_fit_packing.Words(PATH), random.Random(2)
    texts = ["  a  b ", "x\n y \n z", "a  b", "it's O'Neil's 3rd,4th don't", "x <|endoftext|> y", " ", "", "é naïve,x ßa. ×a ÷", "日本 語、 x", "a\x1c b \x1cc", "aé b", "ba's c"]
    texts += ["".join(r.choice(["a", "b", " ", " ", "\n", "\t", ".", ",", "'s", "é", "1", "ß", "日", "%%", "\x1c", " "]) for _ in range(60)) for _ in range(1500)]
    for size in (1 << 20, 20):
        monkeypatch.setattr(best_fit_packing, "PIECE_CHARS", size)
        for text in texts:
            ids = whole.encode(text, add_special_tokens=False).ids
            assert words.ids(text) == b"".join(i.to_bytes(4, "little") for i in ids), repr(text)


def test_packing(spark):
    """A third of the rows are empty texts; long ones are cut; each piece is read back from its sequence."""
    r = random.Random(8)
    docs = [(i, None if i % 6 == 0 else "" if i % 6 == 1 else " ".join(r.choice(["one", "two,", "three\n", "émile"]) for _ in range(r.randrange(1, 400)))) for i in range(300)]
    docs += [(i, docs[2][1]) for i in (2, 3, None, None)] + [(900, "word " * 5000), (901, "é" * 700), (902, "a" * 2047)]
    packed = best_fit_packing.best_fit_packing(spark.createDataFrame([(*x, 0) for x in docs], "doc_id bigint, text string, rank int"), PATH).cache()
    got, whole = packed.collect(), Tokenizer.from_file(PATH)
    want = sorted((str(i), [*whole.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in docs)
    pieces = sorted((str(i), k, len(x) if n == 1 else (len(x) - 1) % 1024 + 1 + 1024 * k, len(x)) for i, x in want for n in [-(-len(x) // 1024)] for k in range(n))
    assert sorted((str(x.doc_id), x.piece, x.start + x.length, next(len(w) for i, w in want if i == str(x.doc_id) and len(w) >= x.start + x.length)) for x in got if x.doc_id is not None and x.doc_id not in (2, 3)) == [p for p in pieces if p[0] not in ("None", "2", "3")]
    ids = {i: w for i, w in want}
    unpack = lambda b: [int.from_bytes(b[k : k + 4], "little") for k in range(0, len(b), 4)]
    held = collections.defaultdict(list)
    for x in got:
        assert zlib.crc32(x.ids) == x.ids_crc32 and len(x.ids) == 4 * x.length and x.length <= 1024
        if x.doc_id not in (None, 2, 3):
            assert unpack(x.ids) == ids[str(x.doc_id)][x.start : x.start + x.length]
        held[x.sequence_id].append((x.offset, x.length, x.ids))
    for spans in held.values():
        ends = [0, *itertools.accumulate(n for _, n, _ in sorted(spans))]
        assert [o for o, _, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 1024
    assert len(held) == best_fit([x.length for x in got], 1024)
    assert {x.sequence_id: bytes(x.ids) for x in best_fit_packing.sequences(packed).collect()} == {k: b"".join(i for _, _, i in sorted(v)) for k, v in held.items()}
    assert best_fit_packing.digest(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
