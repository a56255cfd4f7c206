r"""Best-fit packing, planned over a histogram of lengths.

Documents are tokenised where they are read, and cut to pieces of at most `capacity` ids. Only the count of pieces of each
length (at most `capacity` numbers) reaches the driver, where best-fit decreasing runs over counts: all pieces of a length
enter all sequences of one room at a time. The plan is a few rows for each length, whatever the corpus: slots for ranks
from..to, which fill sequences of consecutive numbers. A piece's rank among those of its length is its rank within its task
plus the pieces of that length in earlier tasks; a join on length and rank gives it its slot. So no length is gathered or
sorted, although a third of all pieces may have one length; ids are shuffled only if sequences are to be put together.

Bound of the plan: a length splits at most one range of sequences in three, so there are at most 3 * capacity ranges; a
sequence holds at most 44 distinct lengths if capacity is 1024, so a range has at most 45 rows of the plan.

Tokens: a text is cut before each space between two characters that are no white space. The tokenizer begins a token there
in any case, so ids of the words are the text's ids, and a word is tokenised once a task while the cache of it has room.

Defined cases: a null or empty text is the end token alone; repeated rows, and rows without doc_id, are documents of their
own; a special token's string in a text becomes that token, as the tokenizer has it; the first piece of a document that is
cut is the shorter one; an empty table gives no rows; other columns are not read. A very long text is tokenised a MB at a
time, and only its ids (4 bytes each) are whole. Which of several pieces of one length takes which slot is not defined.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, tidy

CAPACITY, END = 1024, 2
#: Words that a task keeps the ids of.
CACHED = 600_000
#: Characters of a text that are cut to words at once.
PIECE_CHARS = 1 << 20
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Letters, then nothing or what begins with another token: an ASCII sign that is no apostrophe.
_CORE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~].*)?", re.S)


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if _LITTLE else struct.pack(f"<{len(ids)}I", *ids)


class _Odd(Exception):
    """A word that is empty, or has white space at an end."""


class _Known(dict):
    """Ids of words, made when they are first asked for, and kept while there is room."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Odd
        ids = self.make(word)
        if len(self) < CACHED:
            self[word] = ids
        return ids


class Words:
    """Ids of texts as little-endian 32-bit numbers, words by a cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = _Known(self.word)
        self.cores: dict[str, bytes] = {}
        # how byte-level BPE spells letters beyond ASCII, as the tokenizer itself has it
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelt = {i: spell(chr(i))[0][0] for i in range(0xC0, 0x250) if i not in (0xD7, 0xF7)}
        self.space = spell(" a")[0][0][0]
        self.ends: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        """Ids of a space and a word without white space. The letters it begins with are a token of the first step."""
        if word.isascii() and word.isalpha():
            core, rest = word, None
        elif m := _CORE.fullmatch(word):
            core, rest = m.groups()
        else:
            return self.plain(" " + word)
        if (ids := self.cores.get(core)) is None:
            spelt = core if core.isascii() else core.translate(self.spelt)
            ids = _packed([t.id for t in self.model.tokenize(self.space + spelt)])
            if len(self.cores) < CACHED:
                self.cores[core] = ids
        if not rest:
            return ids
        if (more := self.ends.get(rest)) is None:
            more = self.plain(rest)
            if len(self.ends) < CACHED:
                self.ends[rest] = more
        return ids + more

    def part(self, text: str, first: bool) -> bytes:
        """first: nothing stands before text; else it begins with a space and a word."""
        head, *words = text.split(" ")
        if not first:
            head = ""
        if first and words and (not head or head[-1].isspace()):
            return self.odd(text, first)
        try:
            done = b"".join(map(self.known.__getitem__, words))
        except _Odd:
            return self.odd(text, first)
        return (self.plain(head) if head else b"") + done

    def odd(self, text: str, first: bool) -> bytes:
        """A part in which spaces stand beside other white space."""
        found = []
        for i, w in enumerate(_CUT.split(text)):
            known = None if i == 0 and first else self.known.get(w[1:])
            found.append(self.plain(w) if known is None else known)
        return b"".join(found)

    def ids(self, text: str) -> bytes:
        at, parts = 0, []
        while len(text) - at > PIECE_CHARS and (m := _CUT.search(text, at + PIECE_CHARS)):
            parts.append(self.part(text[at : m.start()], not at))
            at = m.start()
        return b"".join([*parts, self.part(text[at:] if at else text, not at)])


_LOADED: dict[str, Words] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (little-endian unsigned 32 bits each) for each piece of a document, and
    where it stands among those of its length: task, rank. A plan over it must read it written, as ranks are by task."""
    last, kind = _packed([end]), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _LOADED.get(tokenizer) or _LOADED.setdefault(tokenizer, Words(tokenizer))
        task, ranks = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text"):
            rows, numbers, starts, lengths, sums, found, places = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = (words.ids(text) if text else b"") + last
                n = len(ids) // 4
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    own = ids[4 * a : 4 * b]
                    rows.append(i)
                    numbers.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(own))
                    found.append(own)
                    places.append(int(ranks[b - a]))
                    ranks[b - a] += 1
            whole = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(whole(rows)), pa.array(numbers, pa.int32()), whole(starts), whole(lengths), whole(sums), pa.array(found, pa.binary()), pa.array([task] * len(rows), pa.int32()), whole(places)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "rank"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, task int, rank bigint")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: (length, from, to, sequence, each, offset). Pieces of that length and of
    ranks from..to-1 go, `each` to a sequence, to consecutive sequences from `sequence` on, side by side from `offset` on."""
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    slots, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        for room in range(length, capacity + 1):
            # the fullest sequences that have room take as many as they can, as the next of this length would fit them best
            each = room // length
            if room == capacity and left:
                rooms[room] = [(opened, opened + -(-left // each))]
                opened = rooms[room][0][1]
            held, rooms[room] = rooms[room], []
            for first, stop in held:
                for n in (each, left % each):
                    full = min(stop - first, left // n) if n else 0
                    if full:
                        slots.append((length, rank, rank + full * n, first, n, capacity - room))
                        rooms[room - n * length].append((first, first + full))
                        rank, left, first = rank + full * n, left - full * n, first + full
                if first < stop:
                    rooms[room].append((first, stop))
            if not left:
                break
    return slots


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of documents (see pieces()) with sequence_id and offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, capacity, end))
    counts = materialize(cut.groupBy("task", "length").agg(F.count("*").alias("n")), False)
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    schema = "p_length bigint, from bigint, to bigint, sequence bigint, each bigint, base bigint"
    slots = F.broadcast(spark.createDataFrame(plan(lengths, capacity), schema))  # bounded by capacity, see above
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    nth = F.col("rank") - F.col("from")
    placed = ranked.join(slots, (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to")))
    sequence = F.col("sequence") + F.floor(nth / F.col("each"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", sequence.cast("bigint").alias("sequence_id"), (F.col("base") + nth % F.col("each") * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (of the whole sequence), documents (doc_id, piece, offset, length, in order): capacity pieces at most."""
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("x"))
    ids = F.aggregate("x", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return whole.select("sequence_id", ids.alias("ids"), F.transform("x", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("documents"))


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return best_fit_packing(docs, str(tokenizer)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
