"""BPE encoding and decoding by tree concatenation.

A text of more than LEAF characters is halved again and again, wherever the
halves happen to end. The leaves of a batch of texts are encoded together, and
put together pairwise up the trees, a level at a time. At each join a window of tokens from both
sides is encoded anew, by the library and with all its rules, and widened until
it agrees with both sides. The pattern before the merges never joins white space
to what stands before it, so where the window holds such places on both sides,
what lies between them must come out the same. Else a side is taken up again
where both encodings begin a word (a piece that the pattern gives) at the same
byte, as the pattern then goes on alike, or, inside a word that is longer than
the window, where both have the same token at the same bytes, as a sequence of
merges is right if and only if each pair of neighbours is. Decoding joins the
bytes of the tokens.

Leaves and windows are merged by the library's model. Cutting them into words by
the pattern takes most of the library's time, so for the usual pattern the words'
ends are found here for all texts of a batch at once, by what the library's own
pattern says of each character when it is first met; nothing is kept of words.
Texts that hold a special token, and files with another pattern, are left to the library.

Texts of more than SPREAD characters are cut into parts that are encoded in
tasks of their own; each such text's parts then meet in one task, which joins them.

Defined cases: a null text counts as empty; an empty text has no tokens; an
empty table gives an empty result; the text of a special token inside a text
becomes that token, as is the library's default.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import materialize, slices, small_batches
from driftline.llm.token_counts import batches

#: Characters of a leaf of the tree at most, and the tokens on each side of a first window.
LEAF, WINDOW = 1024, 16
#: Characters from which a text's parts are dealt out, and of such a part.
SPREAD, PART = 1 << 16, 1 << 14
#: Bytes after the end of a word that its pattern may have looked at: three characters.
AHEAD = 12
#: White space of one byte (fixed values).
SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
#: Tokens on a side within which white space is looked for.
NEAR = 128
#: Documents to a batch of results.
ROWS = 256

#: The pattern whose words are found here; all else is left to the library.
USUAL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: What a character is to that pattern; 0 is not asked yet.
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
#: What an apostrophe that begins a word takes with it: one letter, or two.
SHORT, LONG = [ord(c) for c in "stmd"], [(ord(x), ord(y)) for x, y in ("re", "ve", "ll")]

_loaded: dict = {}


class Ids:
    """Ids of a text, and which of them begin a word where that is known already."""

    def __init__(self, ids: np.ndarray, begins: np.ndarray | None = None):
        self.ids, self.begins = ids, begins

    def __len__(self) -> int:
        return len(self.ids)


class Coder:
    """Encoder and decoder of one byte-level BPE file."""

    def __init__(self, path: str, leaf: int = LEAF):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.leaf = leaf
        file = json.loads(self.whole.to_str())
        self.special = special = [t["content"] for t in file["added_tokens"]]
        # a window's side must be longer than a special token that a join cuts, and than what a pattern looks at
        self.window = max([WINDOW, AHEAD + 1, *(len(x.encode()) + 1 for x in special)])
        letters = {c: b for b, c in byte_letters().items()}
        self.merger = None
        if file["normalizer"] is None and {k: v for k, v in (file["pre_tokenizer"] or {}).items() if k != "trim_offsets"} == USUAL:
            self.merger = Tokenizer(self.whole.model)
            self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")  # no byte's letter
            self.kinds = np.zeros(0x110000, np.uint8)
            self.letters = np.array([ord(c) for _, c in sorted(byte_letters().items())], np.uint16)
        self.bytes = []
        for i in range(self.whole.get_vocab_size(with_added_tokens=True)):
            t = self.whole.id_to_token(i)
            self.bytes.append(t.encode() if t in special else bytes(letters[c] for c in t))
        self.spaced = np.array([x[:1] in SPACES for x in self.bytes]) & (not any(x in t.encode() for t in special for x in SPACES))
        self.plain = np.array([0x20 < x[-1] < 0x7F if x else False for x in self.bytes])

    def halves(self, text: str) -> list[str]:
        """Halves of halves of at most ``leaf`` characters; their number is a power of two."""
        parts = [text]
        while len(parts[0]) > self.leaf:
            parts = [y for x in parts for y in (x[: (len(x) + 1) // 2], x[(len(x) + 1) // 2 :])]
        return parts

    def parsed(self, texts: list[str]) -> list[Ids]:
        out = []
        for e in self.whole.encode_batch(texts, add_special_tokens=False):
            words = np.array(e.word_ids, np.int64)
            out.append(Ids(np.array(e.ids, np.uint32), np.append(True, words[1:] != words[:-1]) if len(words) else np.zeros(0, bool)))
        return out

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of short texts, each by itself."""
        left = [self.merger is None or any(t in x for t in self.special) for x in texts]
        plain = iter(self.whole.encode_batch_fast([x for x, y in zip(texts, left, strict=True) if y], add_special_tokens=False))
        cut = self.words([x for x, y in zip(texts, left, strict=True) if not y])
        merged = iter(self.merger.encode_batch_fast(cut, add_special_tokens=False) if cut else [])
        return [np.array(next(plain if y else merged).ids, np.uint32) for y in left]

    def words(self, texts: list[str]) -> list[str]:
        """What the merger takes: the letters of a text's bytes, and a line end before each word but the first."""
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        if not len(codes):
            return texts
        ends = np.cumsum([len(x) for x in texts])
        first = np.zeros(len(codes) + 1, bool)
        first[0] = first[ends] = True
        begins = self.begins(codes, first) & ~first[:-1]
        data = np.frombuffer(whole.encode(), np.uint8)
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        places = chars[:-1][begins]
        held = np.ones(len(data) + len(places), bool)
        held[places + np.arange(len(places))] = False
        out = np.full(len(held), ord("\n"), "<u2")
        out[held] = self.letters[data]
        text = out.tobytes().decode("utf-16-le")
        cuts = [0, *(chars[ends] + np.searchsorted(places, chars[ends])).tolist()]
        return [text[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def begins(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the pattern begins a word; ``first`` marks the beginnings of texts, and the end."""
        kinds = self.kinds[codes]
        if not kinds.all():
            self.ask(np.unique(codes[kinds == 0]))
            kinds = self.kinds[codes]
        out = first[:-1].copy()
        out[1:] |= kinds[1:] != kinds[:-1]
        # the last white space before something else stands alone, or goes with that if it is a blank
        space = kinds == SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:-1])
        out[last] = True
        out[last[codes[last] == 0x20] + 1] = False
        at = np.flatnonzero(out & (codes == ord("'")))
        if len(at):
            x, y = (np.where(at + k < len(codes), codes[np.minimum(at + k, len(codes) - 1)], 0) for k in (1, 2))
            x[first[at + 1]] = 0
            y[first[np.minimum(at + 2, len(codes))]] = 0
            one = np.isin(x, SHORT)
            two = np.logical_or.reduce([(x == a) & (y == b) for a, b in LONG])
            out[at[one | two] + 1] = False
            after = np.concatenate([at[one] + 2, at[two] + 3])
            out[after[after < len(codes)]] = True
        return out

    def ask(self, codes: np.ndarray) -> None:
        """Has the library's pattern say what characters are: of each kind's own it makes one word."""
        chars = [chr(x) for x in codes.tolist()]
        text = "".join(f"a{x}a\n1{x}1\n!{x}!\n" for x in chars)
        found = {i for _, (i, j) in self.whole.pre_tokenizer.pre_tokenize_str(text) if j - i == 3}
        of = lambda i: LETTER if i in found else NUMBER if i + 4 in found else OTHER if i + 8 in found else SPACE
        self.kinds[codes] = [of(12 * k) for k in range(len(chars))]

    def trees(self, texts: list[str]) -> list[Ids]:
        """The ids of texts, each from its leaves."""
        split = [self.halves(x) for x in texts]
        leaves = iter([Ids(x) for x in self.ids_of([y for x in split for y in x])])
        return self.grown([[next(leaves) for _ in x] for x in split])

    def joined(self, parts: list[Ids]) -> Ids:
        """The ids of what consecutive parts stand for together, pairwise up a tree."""
        return self.grown([parts])[0]

    def grown(self, trees: list[list[Ids]]) -> list[Ids]:
        """The same for many trees, whose joins of one level are made together."""
        while any(len(x) > 1 for x in trees):
            made = iter(self.joins([(x[i], x[i + 1]) for x in trees for i in range(0, len(x) - 1, 2)]))
            trees = [[next(made) if i + 1 < len(x) else x[i] for i in range(0, len(x), 2)] for x in trees]
        return [x[0] for x in trees]

    def join(self, a: Ids, b: Ids) -> Ids:
        """The ids of what ``a`` and ``b`` stand for together."""
        return self.joins([(a, b)])[0]

    def joins(self, pairs: list[tuple[Ids, Ids]]) -> list[Ids]:
        out = [None if len(a) and len(b) else a if len(a) else b for a, b in pairs]
        w = self.window
        while w <= NEAR and None in out:
            self.join_at_spaces(pairs, out, w)
            w *= 2
        return [x or self.join_in_words(self.with_words(a), self.with_words(b)) if len(a) and len(b) else x for x, (a, b) in zip(out, pairs, strict=True)]

    def join_at_spaces(self, pairs: list[tuple[Ids, Ids]], out: list[Ids | None], w: int) -> None:
        """Fills in what is None, where a window with white space on both sides agrees."""
        held, texts = [], []
        for k, (a, b) in enumerate(pairs):
            if out[k] is not None:
                continue
            start, end = max(0, len(a) - w), min(len(b), w)
            left, right = (np.flatnonzero(self.spaced[x[1:]] & self.plain[x[:-1]]) + 1 for x in (a.ids[start:], b.ids[:end]))
            if len(left) > 1 and len(right) > 1:
                low, i, j, high = start + int(left[0]), start + int(left[-1]), int(right[0]), int(right[-1])
                held.append((k, low, i, j, high))
                # at white space the text is cut between characters
                texts.append((self.decode_bytes(a.ids[low:]) + self.decode_bytes(b.ids[:high])).decode())
        for (k, low, i, j, high), middle in zip(held, self.ids_of(texts), strict=True):
            a, b = pairs[k]
            if np.array_equal(middle[: i - low], a.ids[low:i]) and np.array_equal(middle[len(middle) - (high - j) :], b.ids[j:high]):
                out[k] = Ids(np.concatenate([a.ids[:low], middle, b.ids[high:]]))

    def with_words(self, a: Ids) -> Ids:
        return a if a.begins is not None else self.parsed([self.decode_bytes(a.ids).decode()])[0]

    def join_in_words(self, a: Ids, b: Ids) -> Ids:
        w = self.window
        while True:
            low, high = max(0, len(a) - w), min(len(b), w)
            near = np.flatnonzero(a.begins[max(0, low - w) : low + 1])
            low = max(0, low - w) + int(near[-1]) if len(near) else low
            middle = self.window_of(a.ids[low:], b.ids[:high])
            if middle is not None:
                left = self.agree_left(a, low, middle)
                right = (len(b), len(middle)) if high == len(b) else self.agree_right(a, low, b, high, middle)
                if left is not None and right is not None and left[1] <= right[1]:
                    (i, m), (j, n) = left, right
                    join = lambda x, y, z: np.concatenate([x[:i], y[m:n], z[j:]])  # noqa: B023, E731
                    return Ids(join(a.ids, middle.ids, b.ids), join(a.begins, middle.begins, b.begins))
            if low == 0 and high == len(b):
                raise ValueError("the whole of both sides must be text")
            w *= 2

    def window_of(self, a: np.ndarray, b: np.ndarray) -> Ids | None:
        """None if the window cuts a character."""
        try:
            return self.parsed([(self.decode_bytes(a) + self.decode_bytes(b)).decode()])[0]
        except UnicodeDecodeError:
            return None

    def places(self, ids: np.ndarray) -> list[int]:
        """Where each token begins, in bytes, and the end."""
        return list(accumulate((len(self.bytes[i]) for i in ids.tolist()), initial=0))

    def agree_left(self, a: Ids, low: int, middle: Ids) -> tuple[int, int] | None:
        """(i, m): the ids are a's up to i and the window's from m on."""
        if low == 0 or a.begins[low]:
            return low, 0
        # inside a long word: the same token in both
        at = dict(zip(self.places(middle.ids)[:-1], range(len(middle)), strict=True))
        for i, place in zip(range(low, len(a)), self.places(a.ids[low:]), strict=False):
            m = at.get(place)
            if a.begins[i] or (m and middle.begins[m]):
                return None
            if m and middle.ids[m] == a.ids[i] and not middle.begins[1 : m + 1].any():
                return i, m
        return None

    def agree_right(self, a: Ids, low: int, b: Ids, high: int, middle: Ids) -> tuple[int, int] | None:
        """(j, n): the ids are the window's up to n and b's from j on."""
        start = sum(len(self.bytes[i]) for i in a.ids[low:].tolist())
        held = self.places(middle.ids)
        at = dict(zip(held[:-1], range(len(middle)), strict=True))
        one_word = True
        for j, place in zip(range(high), self.places(b.ids[:high]), strict=False):
            if start + place + AHEAD > held[-1]:
                return None
            one_word = one_word and not (j and b.begins[j])
            n = at.get(start + place)
            if n is None:
                continue
            if b.begins[j] and middle.begins[n]:
                return j, n
            # inside a long word: the same token in both, and no other word from the join on
            if j and one_word and middle.ids[n] == b.ids[j] and not middle.begins[np.searchsorted(held, start) : n + 1].any():
                return j, n
        return None

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes[i] for i in ids.tolist()])

    def decoded(self, ids: np.ndarray) -> bytes:
        """In UTF-8; bytes that are none (which no text gives) become U+FFFD, as in the library."""
        return self.decode_bytes(ids).decode(errors="replace").encode()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; those that are no longer than a leaf are encoded by themselves."""
        for group in batches(texts):
            short = [x for x in group if len(x) <= self.leaf]
            long = [x for x in group if len(x) > self.leaf]
            plain = iter(self.ids_of(short))
            grown = iter(self.trees(long))
            for x in group:
                yield next(plain) if len(x) <= self.leaf else next(grown).ids


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def coder(path: str) -> Coder:
    if path not in _loaded:
        _loaded.clear()  # a worker stays for later queries, with the last vocabulary
        _loaded[path] = Coder(path)
    return _loaded[path]


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS = ", ids array<int>, decoded string"


def results(c: Coder, every: list[np.ndarray], with_ids: bool) -> tuple[list[pa.Array], list[str]]:
    ids = [x.astype("<u4").tobytes() for x in every]
    decoded = [c.decoded(x) for x in every]
    columns = [pa.array([len(x) for x in every], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]
    if with_ids:
        columns += [pa.array([x.astype("int32") for x in every], pa.list_(pa.int32())), pa.array([x.decode() for x in decoded], pa.string())]
    return columns, [x.split()[0] for x in (RESULT + IDS * with_ids).split(", ")]


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, spread: int = SPREAD, part: int = PART) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; ``with_ids`` adds ids and decoded."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for held in slices(parts, ROWS):
            columns, names = results(c, list(c.encode(held.column(1).to_pylist())), with_ids)
            yield pa.RecordBatch.from_arrays([held.column(0), *columns], names=["doc_id", *names])

    usual = small_batches(source.where(F.length("text") <= spread)).mapInArrow(run, f"doc_id {kind}, {RESULT}{IDS * with_ids}")
    return usual.unionByName(_spread(source.where(F.length("text") > spread), path, with_ids, part))


def _spread(source: DataFrame, path: str, with_ids: bool, size: int) -> DataFrame:
    """The same for long texts, whose parts are encoded in tasks of their own; equal texts are encoded once."""
    keys = [F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("digest")]

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in slices(parts, 8):
            for key, digest, text in zip(*[c.to_pylist() for c in held.columns], strict=True):
                pieces = [text[a : a + size] for a in range(0, len(text), size)]
                n = len(pieces)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([digest] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(pieces, pa.string())], names=["key", "digest", "k", "piece"])

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for held in slices(parts, 16):
            found = c.trees(held.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*held.columns[:3], pa.array([x.ids.astype("<u4").tobytes() for x in found], pa.binary())], names=["key", "digest", "k", "ids"])

    def join(held: pa.Table) -> pa.Table:
        c = coder(path)
        held = held.sort_by("k")
        parts = [Ids(np.frombuffer(x, "<u4")) for x in held.column("ids").to_pylist()]
        columns, names = results(c, [c.joined(parts).ids], with_ids)
        return pa.Table.from_arrays([held.column("key").slice(0, 1).combine_chunks(), held.column("digest").slice(0, 1).combine_chunks(), *columns], names=["key", "digest", *names])

    named = source.select("doc_id", *keys)
    texts = small_batches(source.select(*keys, "text").dropDuplicates(["key", "digest"]))
    pieces = texts.mapInArrow(cut, "key long, digest string, k int, piece string")
    tasks = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = pieces.repartition(tasks, "key", "k").mapInArrow(encode, "key long, digest string, k int, ids binary")
    whole = parts.groupBy("key", "digest").applyInArrow(join, f"key long, digest string, {RESULT}{IDS * with_ids}")
    whole = materialize(whole, "long-texts").withColumnRenamed("key", "of_key").withColumnRenamed("digest", "of_digest")
    both = named.join(whole, (F.col("key") == F.col("of_key")) & (F.col("digest") == F.col("of_digest")))
    return both.drop("key", "digest", "of_key", "of_digest")
