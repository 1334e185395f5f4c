"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For every prefix of a segment the table holds the last token of that prefix's encoding. It is unique:
of all vocabulary entries that end at a position (an Aho-Corasick automaton reports them), exactly one
forms a pair with the last token of the prefix before it that the merge order would leave apart. The
ids are then read off backwards from the last prefix.

Segments: no piece of the vocabulary holds the space mark after another character, so texts are cut
before each run of marks, and a bounded cache keeps the ids of segments that come again. Pieces that are
runs of marks only share one score, the lowest: the merge order has ties there, which a table of prefixes
can't settle, so runs are merged after the words, leftmost first. Loading a model checks both conditions.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, texts, trimmed

MARK = "▁"
#: Most entries of the caches of a Python worker; segments have two generations of this size. The smaller one is for workers that
#: other stages use too, and that keep what those left.
CACHE, SHARED_CACHE = 250_000, 60_000
PAIRS = 400_000
#: Segments longer than this are not kept in the cache.
CACHED_CHARS = 48
#: Ids that are gathered before their texts are handed on.
GATHER = 300_000


class PrefixTableCodec:
    """Encoder and decoder for BPE models with identity normalization, a dummy prefix and byte fallback."""

    def __init__(self, path: str, cache: int = CACHE):
        self.size = cache
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        probe = " Ａ ́e  x"
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("only models with identity normalization and a dummy prefix are supported")
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {i: int(self.pieces[i][3:5], 16) for i in range(n) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        if len(self.byte_id) != 256:
            raise ValueError("the model needs byte fallback")
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in self.bytes and i not in special}
        # a merge comes earlier, the higher the score of what it makes; characters come before all merges
        self.runs = {len(p): i for p, i in self.ids.items() if not p.strip(MARK)}
        merged = sorted((i for p, i in self.ids.items() if p.strip(MARK) and len(p) > 1), key=lambda i: -model.get_score(i))
        score = {i: model.get_score(i) for i in merged}
        if 1 not in self.runs or any(MARK in self.pieces[i][1:] for i in merged) or len({*score.values()}) < len(merged) or max((model.get_score(i) for n, i in self.runs.items() if n > 1), default=-1e30) >= min(score.values()) or len({model.get_score(i) for n, i in self.runs.items() if n > 1}) > 1:
            raise ValueError("marks inside pieces or tied scores: the prefix table isn't unique for this model")
        self.order = {i: -1.0 for p, i in self.ids.items() if len(p) == 1} | {i: float(k) for k, i in enumerate(merged)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self._pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for i in sorted(self.order, key=self.order.__getitem__):
            piece = self.pieces[i]
            if len(piece) == 1 or self._derive(piece, i):
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.single = {p for p in self.ids if len(p) == 1}
        self.touch = {pair for i in self.order for pair in zip(self.pieces[i], self.pieces[i][1:])}
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.shown = ["" if model.is_control(i) else " ⁇ " if model.is_unknown(i) else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.unknown = model.unk_id()

    def _derive(self, piece: str, token: int) -> bool:
        """Find the two tokens whose merge makes the piece; False if merging its characters never gives it."""
        parts = self._merge([self.ids.get(c, -1) for c in piece], stop=token)
        if parts is None or len(parts) != 2:
            return False
        self.halves[token] = (parts[0], parts[1])
        self.joined[parts[0], parts[1]] = token
        return True

    def _merge(self, parts: list[int], stop: int) -> list[int] | None:
        """Merge single characters in the model's order until two tokens are left that give `stop`."""
        if -1 in parts:
            return None
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                made = self.ids.get(self.pieces[parts[k]] + self.pieces[parts[k + 1]])
                if made is not None and (best is None or self.order[made] < self.order[best]):
                    best, at = made, k
            if best is None:
                return None
            if best == stop:
                return parts if len(parts) == 2 else None
            parts[at : at + 2] = [best]
        return None

    def compatible(self, left: int, right: int) -> bool:
        """Would merging leave these two tokens apart when they meet?

        Undo the merges at the seam from the latest back; as soon as the tokens there would have merged
        with each other before the merge that hides them, the pair can't stand.
        """
        order, halves, latest = self.order, self.halves, float("inf")
        while True:
            made = self.joined.get((left, right))
            # at equal order the left merge goes first; `latest` is then just above the right one
            if made is not None and order[made] < latest:
                return False
            if order[left] > order[right]:
                latest = order[left]
                left = halves[left][1]
            elif order[right] >= 0:
                latest = order[right] + 0.5
                right = halves[right][0]
            else:
                return True

    def segment_ids(self, segment: str) -> list[int]:
        """Ids of one segment: fill the table of last tokens, then go back from its end."""
        n = len(segment)
        last = [-1] * (n + 1)  # -1: not filled, -2: the start, or a character that goes by its bytes
        size = [1] * (n + 1)
        last[0] = -2
        if not self.single.issuperset(segment):
            for k, c in enumerate(segment):
                if c not in self.single:
                    last[k + 1] = -2
        pairs, known = self._pairs, self._pairs.get
        for end, (token, length) in self.automaton.iter(segment):
            end += 1
            if last[end] != -1:
                continue
            left = last[end - length]
            if left != -2:
                stands = known(left << 20 | token)
                if stands is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    stands = pairs[left << 20 | token] = self.compatible(left, token)
                if not stands:
                    continue
            last[end] = token
            size[end] = length
        out: list[int] = []
        end = n
        while end:
            token = last[end]
            if token >= 0:
                out.append(token)
            elif token == -2:
                out.extend(self.byte_id[b] for b in reversed(segment[end - 1].encode("utf-8", "surrogatepass")))
            else:
                raise AssertionError("no token ends here")
            end -= size[end]
        out.reverse()
        return out

    def cut_ids(self, segment: str) -> list[int]:
        """segment_ids() over the parts between neighbours that no piece of the vocabulary holds."""
        touch, out, at = self.touch, [], 0
        cuts = [k for k, pair in enumerate(zip(segment, segment[1:]), 1) if pair not in touch]
        if not cuts:
            return self.segment_ids(segment)
        cache = self.cache
        for k in [*cuts, len(segment)]:
            part = segment[at:k]
            ids = cache.get(part) if at else None  # parts after a cut are cached under themselves, without a mark
            if ids is None:
                ids = self.segment_ids(part)
                if at and len(part) <= CACHED_CHARS and len(cache) < 2 * self.size:
                    cache[part] = tuple(ids)
            out.extend(ids)
            at = k
        return out

    def with_marks(self, segment: str) -> tuple[int, ...]:
        """Ids of a segment that may begin with a run of marks, of which a word takes one or none."""
        word = segment.lstrip(MARK)
        n = len(segment) - len(word)
        if n < 2 and word:
            return tuple(self.cut_ids(segment))
        ids = self.cut_ids(MARK + word) if word else [self.runs[1]]
        taken = ids[0] != self.runs[1]
        return tuple(self.run_ids(n - taken) + ids[not taken :])

    def run_ids(self, n: int) -> list[int]:
        """Ids of n marks: any two neighbours whose joined length is a piece merge, leftmost first."""
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        ready = list(range(n - 1)) if 2 in self.runs else []
        while ready:
            k = heapq.heappop(ready)
            j = after[k] if size[k] else n
            if j >= n or size[k] + size[j] not in self.runs:
                continue
            size[k], size[j], after[k] = size[k] + size[j], 0, after[j]
            if after[k] < n:
                before[after[k]] = k
                heapq.heappush(ready, k)
            if before[k] >= 0:
                heapq.heappush(ready, before[k])
        return [self.runs[x] for x in size if x]

    def forget(self) -> None:
        """Empty the caches."""
        self.cache, self.older = {}, {}
        self._pairs.clear()

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        if len(self.cache) >= self.size:
            self.cache, self.older = {}, self.cache
        cache, older, put = self.cache, self.older, out.extend
        for segment in self.cut.findall(MARK + text.replace(" ", MARK)):
            ids = cache.get(segment)
            if ids is None:
                ids = older.get(segment) or self.with_marks(segment)
                if len(segment) <= CACHED_CHARS and len(cache) < 2 * self.size:
                    cache[segment] = ids
            put(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: bytes are joined to characters, space marks become spaces, and the space of the
        dummy prefix goes."""
        if self.bytes.keys().isdisjoint(ids):
            out = "".join(map(self.shown.__getitem__, ids))
        else:
            parts: list[str] = []
            raw = bytearray()
            for i in ids:
                if i in self.bytes:
                    raw.append(self.bytes[i])
                    continue
                if raw:
                    parts.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                parts.append(self.shown[i])
            parts.append(raw.decode("utf-8", "replace"))
            out = "".join(parts)
        dummy = ids and ids[0] not in self.bytes and ids[0] != self.unknown and out.startswith(" ")
        return out[1:] if dummy else out


_codecs: dict[tuple[str, int], PrefixTableCodec] = {}


def codec(path: str, cache: int = CACHE) -> PrefixTableCodec:
    """One codec for each model file, size of caches, and Python worker."""
    if (path, cache) not in _codecs:
        _codecs[path, cache] = PrefixTableCodec(path, cache)
    return _codecs[path, cache]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, cache: int = SHARED_CACHE) -> DataFrame:
    """Encode every whole text and, with decode, decode it again. `cache` bounds the segments that a worker keeps (twice as many at most).

    Returns id_col, ids array<int>, and decoded string with decode. A null or empty text has no ids and decodes to ''.
    Rows are independent: repeated rows give repeated results, an empty table an empty one; other
    columns are not read. No shuffle; memory is bounded by an Arrow batch and the caches.
    """
    where = model or default_model()
    names = [id_col, "ids", *(["decoded"] if decode else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(where, cache)
        for batch in batches:
            at, n, ids, decoded = 0, 0, [], []
            for k, text in enumerate(texts(batch, text_col), 1):
                found = c.encode(text or "")
                ids.append(pa.array(found, pa.int32()))
                if decode:
                    decoded.append(c.decode(found))
                n += len(found)
                if n >= GATHER or k == batch.num_rows:
                    lengths = pa.array([0, *accumulate(map(len, ids))], pa.int32())
                    made = [column(batch, id_col)[at:k], pa.ListArray.from_arrays(lengths, pa.concat_arrays(ids)), pa.array(decoded, pa.string())]
                    yield pa.RecordBatch.from_arrays(made[: len(names)], names)
                    at, n, ids, decoded = k, 0, [], []
        c.forget()  # other stages use the worker next

    picked = docs.select(id_col, text_col)
    schema = T.StructType([picked.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType(), True)), T.StructField("decoded", T.StringType())][: len(names)])
    return picked.mapInArrow(trimmed(run), schema)


def digest_documents(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_documents() with n_tokens and the digests of ids and decoded text in place of both.

    ids_sha256: of the decimal ids joined by commas; decoded_sha256: of the decoded text in UTF-8. The
    digests are taken where the ids are made, so no array of ids goes back to the JVM.
    """
    where = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(where)
        decimal = [str(i) for i in range(len(c.pieces))]
        sha = hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for text in texts(batch, text_col):
                ids = c.encode(text or "")
                n.append(len(ids))
                a.append(sha(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                b.append(sha(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([column(batch, id_col), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(id_col, text_col)
    schema = T.StructType([picked.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return picked.mapInArrow(trimmed(run), schema)
