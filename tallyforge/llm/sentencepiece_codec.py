"""SentencePiece encoding and decoding by a max-plus parallel scan.

The model merges pairs of pieces by score.  A sequence of pieces is what the merges make of its text exactly if every
adjacent pair is what the merges make of the pair's text.  Encoding is therefore a best path over (position, last
piece) with weight 0 for a permitted next piece and minus infinity otherwise, and a chunk of a document acts on the
states at its two boundaries as a max-plus matrix.  No piece crosses the start of a word, so between two starts of words
the matrix is 1 x 1 and the path is looked up word by word; a chunk's matrix is the product of its cut first word, these,
and its cut last word.  A text of up to one chunk is one chunk between such starts.  Longer texts are split; each chunk
yields its matrix on its own, the matrices are combined as a tree, the states at all boundaries come back down the tree,
and each chunk then traces its part of the path back on its own.  The chunks of giant texts are rows of many tasks, and
their tree has two levels, groups of FAN chunks and these groups.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

from .common import ROW, cut, slices, whole_rows

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Texts of more code points are split into chunks of so many.
CHUNK = 16_384
#: The chunks of texts of more code points are dealt to many tasks; those of others run where the text is read.
GIANT = 65_536
#: Chunks whose matrices are combined in one group; two levels hold more chunks than a text of 2**31 bytes has.
FAN = 512
WORD_CACHE = 1 << 18
#: Longer words are not remembered.
LONG_WORD = 64
GAP = "▁"
UNIT = re.compile(f"{GAP}*[^{GAP}]+|{GAP}+")
#: Where a word starts: a gap after something else.
START = re.compile(f"(?<=[^{GAP}]){GAP}")
#: Texts on which a model must agree with its library, else it is not one this codec can read.
PROBES = ["a", " a  b ", "The quick\tbrown\n\nfox", "naïve ﬁne ①Ｗ", "é e\u0301 İ", "日本語 نص 😀\x00", "x" * 40]
State = tuple[int, str]  # how far the last piece ends after a boundary, and the piece ("" at the start of a word)


class Codec:
    """One model in one process."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.id), default=1)
        self.raw = [b""] * n
        for p, i in self.id.items():
            self.raw[i] = p.encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        # words are units of their own if no piece holds a gap after something else
        self.by_word = not any(re.search(f"[^{GAP}]{GAP}", p) for p in self.id)
        self.permitted = lru_cache(1 << 18)(self._permitted)
        self.words: dict[str, bytes] = {}
        if len(self.byte) != 256:
            raise ValueError(f"{model}: no byte fallback")
        for t in PROBES:  # normalisation, the gap before the text and escaping are as assumed here
            if self.ids(self.merge(self.escaped(t))) != sp.encode(t):
                raise ValueError(f"{model}: the model does not merge plain text as this codec does")

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text: merge the adjacent pair of the best score, the leftmost first, until none is left."""
        s = list(text)
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                v = self.score.get(s[i] + s[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if best is None:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def _permitted(self, a: str, b: str) -> bool:
        return self.merge(a + b) == ([a, b] if a else [b])

    def ids(self, pieces: list[str]) -> list[int]:
        """Ids; a piece that is not in the model is a code point, spelt in bytes."""
        out: list[int] = []
        for p in pieces:
            i = self.id.get(p)
            out += [i] if i is not None else [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    @staticmethod
    def escaped(text: str | None) -> str:
        return GAP + text.replace(" ", GAP) if text else ""

    def word_ids(self, s: str) -> np.ndarray:
        """Ids (int32) of whole words of an escaped text: the product of their 1 x 1 matrices."""
        units = UNIT.findall(s)
        if len(self.words) > WORD_CACHE:
            self.words.clear()
        found, out = self.words, []
        for u in units:
            if (ids := found.get(u)) is None:
                ids = np.array(self.sp.encode(u[1:]) if u[0] == GAP and len(u) > 1 else self.ids(self.merge(u)), np.int32).tobytes()
                if len(u) <= LONG_WORD:
                    found[u] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def encode(self, text: str | None, chunk: int = CHUNK) -> np.ndarray:
        """Ids (int32) of a text, by chunks if it is longer than one."""
        s = self.escaped(text)
        if len(s) <= chunk:
            return self.word_ids(s) if self.by_word else np.array(self.sp.encode(text or ""), np.int32)
        parts = list(chunked(s, chunk, self.longest + 1))
        at = path_states([self.transfer(t, a, b, c == 0, c == n - 1) for c, n, t, a, b in parts])
        return np.concatenate([self.trace(t, a, b, c == 0, c == n - 1, i, j) for (c, n, t, a, b), (i, j) in zip(parts, at)])

    def decode(self, ids) -> str:
        """Text of ids: the gap character reads as a space, the one before the text goes."""
        t = b"".join(map(self.raw.__getitem__, np.asarray(ids, np.int64).tolist())).decode("utf-8", "replace").replace(GAP, " ")
        return t[1:] if t[:1] == " " else t

    # -- chunks -----------------------------------------------------------------------------------------------------

    def nexts(self, s: str, p: int) -> list[str]:
        """Pieces of the model that match s at p; the bare code point if none of its length does."""
        found = [s[p : p + k] for k in range(2, min(self.longest, len(s) - p) + 1) if s[p : p + k] in self.id]
        return [s[p], *found]

    def states(self, s: str, b: int, first: bool, last: bool) -> list[State]:
        """All states a path can have at boundary b of s: pieces that cover b or end there."""
        if first:
            return [(0, "")]
        out = []
        for start in range(max(0, b - self.longest), b):
            out += [(start + len(p) - b, p) for p in self.nexts(s, start) if start + len(p) >= b and not (last and start + len(p) > b)]
        return sorted(set(out))

    def paths(self, s: str, a: int, b: int, seeds: dict[State, int]) -> dict[int, dict[str, int]]:
        """position -> last piece -> bit set of the seeds whose paths from boundary a get there, up to boundary b."""
        at: dict[int, dict[str, int]] = {}
        for (o, p), bits in seeds.items():
            at.setdefault(a + o, {})[p] = bits
        for pos in range(a, b):
            for piece, bits in at.get(pos, {}).items():
                for q in self.nexts(s, pos):
                    if self.permitted(piece, q):
                        to = at.setdefault(pos + len(q), {})
                        to[q] = to.get(q, 0) | bits
        return at

    def inner(self, s: str, a: int, b: int) -> tuple[int, int] | None:
        """The first and the last start of a word in a..b; None if there is none."""
        if not self.by_word:
            return None
        first = START.search(s, max(0, a - 1), min(len(s), b + 1))
        while first and first.start() < a:
            first = START.search(s, first.end(), min(len(s), b + 1))
        if not first or first.start() > b:
            return None
        last = b if b < len(s) and s[b] == GAP and s[b - 1] != GAP else None
        p = b
        while last is None:
            p = s.rfind(GAP, first.start(), p)
            last = first.start() if p <= first.start() else p if s[p - 1] != GAP else None
        return first.start(), last

    def reach(self, s: str, a: int, b: int, entry: list[State]) -> list[bool]:
        """Of the states at a, those from which a path gets to exactly b, the start of a word."""
        at = self.paths(s, a, b, {e: 1 << i for i, e in enumerate(entry)})
        bits = 0
        for p, found in at.get(b, {}).items():
            if not p or self.permitted("", p):
                bits |= found
        return [bool(bits >> i & 1) for i in range(len(entry))]

    def transfer(self, s: str, a: int, b: int, first: bool, last: bool) -> np.ndarray:
        """Max-plus matrix (states at a, states at b) of the chunk s[a:b] in its surroundings s."""
        entry, leave = self.states(s, a, first, False), self.states(s, b, False, last)
        m = np.full((len(entry), len(leave)), -np.inf, np.float32)
        if (words := self.inner(s, a, b)) is not None:
            head = np.where(self.reach(s, a, words[0], entry), 0, -np.inf)
            at = self.paths(s, words[1], b, {(0, ""): 1})
            tail = np.array([0 if at.get(b + o, {}).get(p) or (b == words[1] and not o) else -np.inf for o, p in leave])
            return (head[:, None] + tail[None, :]).astype(np.float32)
        at = self.paths(s, a, b, {e: 1 << i for i, e in enumerate(entry)})
        for j, (o, p) in enumerate(leave):
            bits = at.get(b + o, {}).get(p, 0)
            for i in range(len(entry)):
                if bits >> i & 1:
                    m[i, j] = 0
        return m

    def path(self, s: str, a: int, entry: State, b: int, leave: State | None) -> list[str]:
        """Pieces after the entry state at a up to and with the last piece of the leaving state at b (None: to b, any)."""
        at = self.paths(s, a, b, {entry: 1})
        if leave is None:
            leave = next((0, p) for p in at[b] if (b - a, p) == entry or self.permitted("", p))
        pos, piece, out = b + leave[0], leave[1], []
        while (pos - a, piece) != entry:
            out.append(piece)
            pos -= len(piece)
            # one text has one path, so one piece before is permitted
            piece = next(p for p, bits in at[pos].items() if self.permitted(p, out[-1]))
        return out[::-1]

    def trace(self, s: str, a: int, b: int, first: bool, last: bool, i: int, j: int) -> np.ndarray:
        """Ids after entry state i up to and with the last piece of leaving state j."""
        entry, leave = self.states(s, a, first, False)[i], self.states(s, b, False, last)[j]
        if (words := self.inner(s, a, b)) is None:
            return np.array(self.ids(self.path(s, a, entry, b, leave)), np.int32)
        f, e = words
        front = self.ids(self.path(s, a, entry, f, None)) if (f - a, entry[1]) != entry else []
        back = self.ids(self.path(s, e, (0, ""), b, leave)) if e < b else []
        return np.concatenate((np.array(front, np.int32), self.word_ids(s[f:e]), np.array(back, np.int32)))


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: the associative combination of neighbouring chunks."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The product of neighbouring chunks, by halves."""
    level = matrices
    while len(level) > 1:
        level = [compose(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def path_states(matrices: list[np.ndarray], entry: int = 0, leave: int | None = None) -> list[tuple[int, int]]:
    """(entry, leaving) state of each chunk on the best path through all of them, down a tree of products.

    leave: the leaving state of the last chunk; by default the best.  Raises if no path goes through.
    """
    tree = [matrices]
    while len(tree[-1]) > 1:
        low = tree[-1]
        tree.append([compose(low[k], low[k + 1]) if k + 1 < len(low) else low[k] for k in range(0, len(low), 2)])
    whole = tree[-1][0]
    leave = int(whole[entry].argmax()) if leave is None else leave
    if not whole[entry, leave] > -np.inf:
        raise ValueError("no path of permitted pieces through the text")
    at = [(entry, leave)]
    for low in tree[-2::-1]:
        down = []
        for k, (i, j) in enumerate(at):
            if 2 * k + 1 < len(low):
                mid = int((low[2 * k][i] + low[2 * k + 1][:, j]).argmax())
                down += [(i, mid), (mid, j)]
            else:
                down.append((i, j))
        at = down
    return at


_codecs: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    if model not in _codecs:
        _codecs[model] = Codec(model)
    return _codecs[model]


def chunked(text: str, chunk: int, context: int) -> Iterator[tuple[int, int, str, int, int]]:
    """(number, of how many, surroundings, first, end): chunk first:end of the surroundings, for an escaped text."""
    n = -(-len(text) // chunk)
    for c in range(n):
        a, b = c * chunk, min(len(text), (c + 1) * chunk)
        lo, hi = max(0, a - context), min(len(text), b + context)
        yield c, n, text[lo:hi], a - lo, b - lo


def gives_back(k: Codec, ids: np.ndarray | list[int], text: str | None) -> bool:
    """Whether the ids decode to the text (null as empty; U+2581, which the model uses for a space, as a space)."""
    return k.decode(ids) == (text or "").replace(GAP, " ")


#: From texts and their ids to the arrays of a result.
Finish = Callable[[Codec, list, list], list[pa.Array]]


def _id_lists(k: Codec, texts: list, ids: list) -> list[pa.Array]:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))]


def _id_lists_checked(k: Codec, texts: list, ids: list) -> list[pa.Array]:
    return [*_id_lists(k, texts, ids), pa.array([gives_back(k, x, t) for x, t in zip(ids, texts)], pa.bool_())]


def _digests(k: Codec, texts: list, ids: list) -> list[pa.Array]:
    sha = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in ids]
    same = [gives_back(k, x, t) for x, t in zip(ids, texts)]
    return [pa.array([len(x) for x in ids], pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())]


def _packed(m: list[np.ndarray]) -> list[pa.Array]:
    """Matrices of 0 and minus infinity, a bit a cell."""
    return [pa.array([x.shape[k] for x in m], pa.int32()) for k in (0, 1)] + [pa.array([np.packbits(x > -np.inf).tobytes() for x in m], pa.binary())]


def _unpacked(rows, cols, packed) -> list[np.ndarray]:
    bits = [np.unpackbits(np.frombuffer(m, np.uint8), count=r * c).reshape(r, c) for r, c, m in zip(rows, cols, packed)]
    return [np.where(x == 1, np.float32(0), np.float32(-np.inf)) for x in bits]


def _finished(rows: DataFrame, more: StructType, finish: Finish, model: str, giant: int, chunk: int) -> DataFrame:
    """rows (column ``row``, a struct with ``text``) with the columns that ``finish`` makes of texts and ids."""
    schema = StructType([*rows.schema.fields, *more.fields])
    made = [ROW, *more.names]

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = codec(model)
        for b in slices(batches):
            texts = b.column(0).field("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), *finish(k, texts, [k.encode(t, chunk) for t in texts])], made)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = codec(model)
        for b in slices(batches, 1):
            key, text = b.column(0)[0].as_py(), b.column(1)[0].as_py()
            parts = list(chunked(k.escaped(text), chunk, k.longest + 1))
            for at in range(0, len(parts), 64):
                c, n, s, x, y = zip(*parts[at : at + 64])
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(c)), *(pa.array(v, pa.int32()) for v in (c, [i // FAN for i in c], n)), pa.array(s), *(pa.array(v, pa.int32()) for v in (x, y))], ["_key", "c", "g", "n", "s", "a", "b"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = codec(model)
        for b in slices(batches, 64):
            c, n, s, x, y = (b.column(i).to_pylist() for i in (1, 3, 4, 5, 6))
            m = [k.transfer(t, u, v, i == 0, i == j - 1) for t, u, v, i, j in zip(s, x, y, c, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *_packed(m)], ["_key", "c", "g", "rows", "cols", "m"])

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("c").sort_values("c")
        rows, cols, m = (x[0].as_py() for x in _packed([product(_unpacked(pdf["rows"], pdf["cols"], pdf["m"]))]))
        return pd.DataFrame({"_key": pdf["_key"].iloc[:1], "g": pdf["g"].iloc[:1], "rows": rows, "cols": cols, "m": [m]})

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g")
        at = path_states(_unpacked(pdf["rows"], pdf["cols"], pdf["m"]))
        return pd.DataFrame({"_key": pdf["_key"].to_numpy(), "g": pdf["g"].to_numpy(), "i": [i for i, _ in at], "j": [j for _, j in at]})

    def down(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("c").sort_values("c")
        at = path_states(_unpacked(pdf["rows"], pdf["cols"], pdf["m"]), int(above["i"].iloc[0]), int(above["j"].iloc[0]))
        return pd.DataFrame({"_key": pdf["_key"].to_numpy(), "c": pdf["c"].to_numpy(), "i": [i for i, _ in at], "j": [j for _, j in at]})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = codec(model)
        for b in slices(batches, 64):
            c, n, s, x, y, i, j = (b.column(v).to_pylist() for v in range(1, 8))
            ids = [k.trace(t, p, q, u == 0, u == w - 1, e, f).tolist() for t, p, q, u, w, e, f in zip(s, x, y, c, n, i, j)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["_key", "c", "part"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = codec(model)
        for b in slices(batches, 1):
            ids = b.column(1).flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), *finish(k, b.column(0).field("text").to_pylist(), [ids])], made)

    size = F.coalesce(F.char_length(F.col(ROW)["text"]), F.lit(0))
    small = rows.where(size <= giant).mapInArrow(ordinary, schema)
    large = cut(rows.where(size > giant).withColumn("_key", F.sha2(F.col(ROW)["text"], 256)))
    if large.isEmpty():
        return small
    # chunks are few bytes and much work: a fixed number of partitions is not merged for being small
    spark = rows.sparkSession
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # copies of one text are chunked once; the filter stands where the join would put it, so all uses share one exchange
    chunks = large.select("_key", F.col(ROW)["text"].alias("text")).dropDuplicates(["_key"]).mapInArrow(split, "_key string, c int, g int, n int, s string, a int, b int").where("_key is not null and c is not null").repartition(wide, "_key", "c")
    m = chunks.mapInArrow(matrices, "_key string, c int, g int, rows int, cols int, m binary")
    above = m.groupBy("_key", "g").applyInPandas(up, "_key string, g int, rows int, cols int, m binary").groupBy("_key").applyInPandas(top, "_key string, g int, i int, j int")
    states = m.groupBy("_key", "g").cogroup(above.groupBy("_key", "g")).applyInPandas(down, "_key string, c int, i int, j int")
    parts = chunks.join(states, ["_key", "c"]).select("_key", "c", "n", "s", "a", "b", "i", "j").mapInArrow(trace, "_key string, c int, part array<int>")
    whole = parts.groupBy("_key").agg(F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("c", "part"))), lambda x: x["part"])).alias("ids"))
    return small.unionByName(large.join(whole, "_key").select(ROW, "ids").mapInArrow(last, schema))


def encode_documents(docs: DataFrame, model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, check: bool = False, names: tuple[str, str] = ("_ids", "_same")) -> DataFrame:
    """docs with their ids (array<int>) appended, and with ``check`` also whether these decode to the text.

    ``names`` are the new columns; columns of docs with these names are replaced, all others kept whatever their names.
    Null and empty texts have no ids; repeated rows are rows of their own.  The result does not depend on ``giant`` and
    ``chunk``.
    """
    docs = docs.drop(*names[: 1 + check])
    more = StructType().add(names[0], ArrayType(IntegerType()))
    if check:
        more = more.add(names[1], BooleanType())
    out = _finished(whole_rows(docs), more, _id_lists_checked if check else _id_lists, model, giant, chunk)
    return out.select(f"{ROW}.*", *more.names)


def decode_documents(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """rows (with ``_ids``) with ``_decoded`` appended; null ids read as no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = codec(model)
        for b in slices(batches):
            t = [k.decode(x if x is not None else []) for x in b.column(b.schema.get_field_index("_ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(t, pa.string())], [*b.schema.names, "_decoded"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("_decoded", StringType()))


def codec_report(docs: DataFrame, model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of the ids as text, comma-joined), round_trip.

    round_trip: decoding gives the text back (null as empty; U+2581, which the model uses for a space, as a space).
    """
    more = StructType().add("n_tokens", LongType()).add("ids_sha256", StringType()).add("round_trip", BooleanType())
    return _finished(whole_rows(docs.select("doc_id", "text")), more, _digests, model, giant, chunk).select(f"{ROW}.doc_id", *more.names)


def encode_stage(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs with the column ``token_ids``, in place of one of that name; see ``encode_documents``."""
    return encode_documents(docs, model, names=("token_ids", "round_trip"))


def codec_stage(docs: DataFrame, model: str = MODEL, giant: int = GIANT) -> DataFrame:
    """docs with ``token_ids`` and ``round_trip``: whether decoding the ids gives the text back, as in ``codec_report``.

    Columns of these names are replaced, all others kept whatever their names.  Null and empty texts have no ids and
    come back as empty; repeated rows are rows of their own; no rows give no rows.
    """
    return encode_documents(docs, model, giant, check=True, names=("token_ids", "round_trip"))
