"""SentencePiece encoding and decoding with a max-plus parallel scan for giant texts (operator 4).

Texts up to CHUNK characters go to the library whole. Longer ones are cut every CHUNK characters, and
the chunks are processed independently, in three steps over a table of chunks:

1. Each chunk gives a transfer matrix from the states at its start to the states at its end, over
   scores 0 (possible) and minus infinity. A state is where the first token boundary at or after the
   cut lies, and which token ends there.
2. The matrices are combined associatively (max-plus products): blocks of BLOCK chunks each give one
   product, independently; the products of a text (at most 1,024, as a text has at most 2^31
   characters) are chained from its first state to its last, which fixes the states at the blocks'
   borders, as only one path is finite; and between its two states each block fixes those at its
   cuts, independently again.
3. Each chunk is traced back on its own between its two states, which gives its ids.

The model here is a byte-pair encoding, whose segmentation is not the best-scored path of a unigram
lattice. The scan is exact for it all the same, because a sequence of tokens is the encoding of its
text if and only if every two neighbours are the encoding of theirs (proved for merges by rank):
with 0 for such neighbours and minus infinity for others, the only finite path of the lattice is the
encoding. For the same reason the only path between two states is the library's encoding of the text
between them, which is what step 3 takes, and encodings of pieces of a chunk may be spliced wherever
the two tokens that meet are such neighbours, so that a matrix costs one encoding of its chunk and
some short ones around its cuts. Models for which this does not hold (unigram, with user-defined
pieces, or without byte fallback) are refused.

Results in odd cases: a null or empty text has no ids and decodes to an empty text; repeated rows
give one result each; an empty table gives an empty result; columns that are not carried are ignored
by `encode_texts`, and carried ones may have any name but those of the results; a text of any length
is handled whole, in chunks.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from functools import cached_property, lru_cache, reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, small_batches, tidy

#: Characters in a chunk; longer texts are giant.
CHUNK = 32_768
#: Chunks whose matrices are combined in one task.
BLOCK = 64
#: Pairs of neighbouring tokens, none longer than the longest piece, whose verdict a worker remembers.
REMEMBERED = 50_000
#: Fixed value: what stands for a space.
SPACE = "▁"

State = tuple[int, str]  # characters after the cut at which the token ends, and the token
#: The state at the start and the end of a text.
SURE: State = (0, "")


class Codec:
    """The library's processor, and what the lattice needs, each made when it is first used: most
    workers never see a giant text."""

    def __init__(self, path: str):
        self.path = path

    @cached_property
    def library(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    @cached_property
    def proto(self):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(self.path, "rb") as file:
            proto.ParseFromString(file.read())
        return proto

    def check(self) -> None:
        """Fails for models that the scan is not exact for."""
        norm, kinds = self.proto.normalizer_spec, pb_names(self.proto)
        for wrong, what in (
            (self.proto.trainer_spec.model_type != kinds["BPE"], "are byte-pair encodings"),
            (norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces, "have a normalizer that changes nothing but spaces"),
            (any(p.type == kinds["USER_DEFINED"] for p in self.proto.pieces), "have no user-defined pieces"),
            (not self.proto.trainer_spec.byte_fallback, "fall back to bytes"),
        ):
            if wrong:
                raise ValueError(f"the codec is for models that {what}")

    @cached_property
    def bare(self):
        """The processor without the prefix."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.CopyFrom(self.proto)
        proto.normalizer_spec.add_dummy_prefix = False
        return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    @cached_property
    def prefix(self) -> str:
        return SPACE if self.proto.normalizer_spec.add_dummy_prefix else ""

    @cached_property
    def pieces(self) -> set[str]:
        return {p.piece for p in self.proto.pieces if p.type == 1}

    @cached_property
    def pairs(self) -> set[str]:
        return {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @cached_property
    def fits(self):
        return lru_cache(maxsize=REMEMBERED)(self._fits)

    @cached_property
    def fits_alone(self):
        return lru_cache(maxsize=REMEMBERED)(lambda token: len(self.bare.encode(token)) == 1)

    def ids(self, text: str) -> list[int]:
        """Ids of normalised text (spaces escaped, prefix there if it is wanted)."""
        return self.bare.encode(text)

    def normal(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def _fits(self, left: str, right: str) -> bool:
        """Whether two tokens are the encoding of their joined text."""
        if left[-1] + right[0] not in self.pairs:
            return True
        return self.bare.encode(left + right) == self.bare.encode(left) + self.bare.encode(right)

    def cuts(self, text: str, size: int) -> list[int]:
        """Positions of the cuts, from 0 to the end of the text."""
        return [*range(0, len(text), size), len(text)]

    def states(self, text: str, at: int) -> list[State]:
        """All states at a cut: tokens that begin before it and end at it or later."""
        found = set()
        for start in range(max(0, at - self.longest), at):
            for end in range(at, min(len(text), start + self.longest) + 1):
                token = text[start:end]
                if (end - start == 1 or token in self.pieces) and self.itself(token):
                    found.add((end - at, token))
        return sorted(found)

    def itself(self, token: str) -> bool:
        """Whether a piece is its own encoding (some pieces are never made)."""
        return len(token) == 1 or self.fits_alone(token)

    def tokens(self, text: str) -> list[str]:
        """The texts of the tokens; a character that is no piece is one token, whatever its bytes."""
        found, at = [], 0
        for n in map(self.steps.__getitem__, self.ids(text)):
            if n:
                found.append(text[at : at + n])
                at += n
        return found

    @cached_property
    def steps(self) -> list[int]:
        """Characters that each id goes forward; of a character's bytes, the first one does."""
        byte = pb_names(self.proto)["BYTE"]
        return [int(int(p.piece[3:5], 16) & 0xC0 != 0x80) if p.type == byte else len(p.piece) for p in self.proto.pieces]

    def matrix(self, text: str, start: int, stop: int, first: bool, last: bool) -> list[tuple[State, State]]:
        """The finite entries of a chunk's transfer matrix; `text` reaches over both cuts, but for the
        start of the first chunk and the end of the last one, where SURE is the only state."""
        entries = [SURE] if first else self.states(text, start)
        ends = [stop] if last else range(stop, min(len(text), stop + self.longest - 1) + 1)
        middle = Path(self, text, start, ends[-1])
        out = []
        for offset, token in entries:
            begin = start + offset
            for end in ends:
                if begin > end:
                    continue
                opens, closes = middle.outer(begin, end) if begin < end else (None, token)
                if opens and token and not self.fits(token, opens):
                    continue
                if last:
                    out.append(((offset, token), SURE))
                elif end - len(closes) < stop:
                    out.append(((offset, token), (end - stop, closes)))
        return out

    def trace(self, text: str, start: int, stop: int, entry: State, leave: State) -> list[int]:
        """Ids of the chunk between two states."""
        return self.ids(text[start + entry[0] : stop + leave[0]])

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


class Path:
    """The encoding of one stretch of a text, from which those of stretches a little shorter or longer
    at either end are spliced."""

    def __init__(self, known: Codec, text: str, start: int, stop: int):
        self.known, self.text = known, text
        self.tokens = known.tokens(text[start:stop])
        self.starts = list(accumulate(map(len, self.tokens), initial=start))
        self.margin = 4 * known.longest
        self.heads: dict[int, tuple[str, int]] = {}
        self.tails: dict[int, tuple[str, int]] = {}

    def outer(self, begin: int, end: int) -> tuple[str, str]:
        """First and last token of the encoding of text[begin:end]."""
        (opens, low), (closes, high) = self.head(begin), self.tail(end)
        if low < high:  # one token of the path at least lies between, and fits both
            return opens, closes
        tokens = self.known.tokens(self.text[begin:end])
        return tokens[0], tokens[-1]

    def head(self, begin: int) -> tuple[str, int]:
        """First token of what begins at `begin`, and the token of the path from which on they agree."""
        if begin not in self.heads:
            found, margin = ("", len(self.tokens)), self.margin
            while begin + margin < self.starts[-1]:
                at = bisect_left(self.starts, begin + margin)
                tokens = self.known.tokens(self.text[begin : self.starts[at]])
                if at < len(self.tokens) and self.known.fits(tokens[-1], self.tokens[at]):
                    found = (tokens[0], at)
                    break
                margin *= 2
            self.heads[begin] = found
        return self.heads[begin]

    def tail(self, end: int) -> tuple[str, int]:
        """Last token of what ends at `end`, and the token of the path before which they agree."""
        if end not in self.tails:
            found, margin = ("", 0), self.margin
            while end - margin > self.starts[0]:
                at = bisect_right(self.starts, end - margin) - 1
                tokens = self.known.tokens(self.text[self.starts[at] : end])
                if at and self.known.fits(self.tokens[at - 1], tokens[0]):
                    found = (tokens[-1], at)
                    break
                margin *= 2
            self.tails[end] = found
        return self.tails[end]


def pb_names(proto) -> dict[str, int]:
    """Numbers of the model and piece types by name."""
    enums = [*type(proto.trainer_spec).DESCRIPTOR.enum_types, *type(proto).DESCRIPTOR.nested_types_by_name["SentencePiece"].enum_types]
    return {v.name: v.number for e in enums for v in e.values}


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def product(a: list[tuple[State, State]], b: list[tuple[State, State]]) -> list[tuple[State, State]]:
    """Max-plus product of two matrices given by their finite entries (all scores are 0)."""
    after: dict[State, list[State]] = {}
    for s, t in b:
        after.setdefault(s, []).append(t)
    return sorted({(s, u) for s, t in a for u in after.get(t, ())})


def settle(matrices: list[list[tuple[State, State]]], first: State = SURE, last: State = SURE) -> list[State]:
    """The state at each cut of the only finite path between two states: forward over what can be
    reached, then back from the end."""
    front = [{first}]
    for m in matrices:
        front.append({t for s, t in m if s in front[-1]})
    states = [last]
    for m, before in zip(reversed(matrices), reversed(front[:-1])):
        states.append(next(s for s, t in m if t == states[-1] and s in before))
    return states[::-1]


def settle_blocks(matrices: list[list[tuple[State, State]]], size: int = BLOCK) -> list[State]:
    """`settle` by blocks, in the order in which tasks do it."""
    blocks = [matrices[i : i + size] for i in range(0, len(matrices), size)]
    borders = settle([reduce(product, b) for b in blocks])
    return [SURE, *[s for b, x, y in zip(blocks, borders, borders[1:]) for s in settle(b, x, y)[1:]]]


def encode_chunked(known: Codec, text: str, size: int, block: int = BLOCK) -> list[int]:
    """The scan in one process, for tests and for use without Spark."""
    whole = known.normal(text)
    if not whole:
        return []
    parts = [(x["text"], x["start"], x["stop"], x["first"], x["last"]) for x in chunks_of(known, text, size)]
    states = settle_blocks([known.matrix(*p) for p in parts], block)
    return [i for p, s, t in zip(parts, states, states[1:]) for i in known.trace(*p[:3], s, t)]


def written(matrix: list[tuple[State, State]]) -> str:
    return json.dumps(matrix)


def read(matrix: str) -> list[tuple[State, State]]:
    return [((s[0], s[1]), (t[0], t[1])) for s, t in json.loads(matrix)]


CHUNKS = "row long, chunk int, text string, start int, stop int, first boolean, last boolean"


def chunks_of(known: Codec, text: str, size: int) -> list[dict]:
    """The chunks with what the states around them need of the text; `start` and `stop` are the cuts
    in that part."""
    text = known.normal(text)
    cuts, margin = known.cuts(text, size), known.longest
    return [
        {"chunk": k, "text": text[max(0, a - margin) : b + margin], "start": min(a, margin), "stop": min(a, margin) + b - a, "first": k == 0, "last": k == len(cuts) - 2}
        for k, (a, b) in enumerate(zip(cuts, cuts[1:]))
    ]


def states_of(chunks: DataFrame, model_path: str) -> DataFrame:
    """(row2, chunk2, entry, leave): the states around each chunk."""

    def matrices(batches):
        known = codec(model_path)
        for batch in batches:
            found = [written(known.matrix(x["text"], x["start"], x["stop"], x["first"], x["last"])) for x in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), pa.array(found, pa.string())], ["row", "chunk", "matrix"])

    def products(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: x["chunk"])
        whole = reduce(product, [read(x["matrix"]) for x in rows])
        return pa.table({"row": [rows[0]["row"]], "block": [rows[0]["block"]], "matrix": [written(whole)]})

    def borders(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: x["block"])
        states = [json.dumps(x) for x in settle([read(x["matrix"]) for x in rows])]
        return pa.table({"row2": [x["row"] for x in rows], "block2": [x["block"] for x in rows], "from": states[:-1], "to": states[1:]})

    def inner(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: x["chunk"])
        states = [json.dumps(x) for x in settle([read(x["matrix"]) for x in rows], tuple(json.loads(rows[0]["from"])), tuple(json.loads(rows[0]["to"])))]
        return pa.table({"row2": [x["row"] for x in rows], "chunk2": pa.array([x["chunk"] for x in rows], pa.int32()), "entry": states[:-1], "leave": states[1:]})

    found = chunks.mapInArrow(tidy(matrices), "row long, chunk int, matrix string").withColumn("block", F.floor(F.col("chunk") / BLOCK).cast("long"))
    blocks = found.groupBy("row", "block").applyInArrow(products, "row long, block long, matrix string")
    ends = blocks.groupBy("row").applyInArrow(borders, "row2 long, block2 long, from string, to string")
    joined = found.join(ends, (F.col("row") == F.col("row2")) & (F.col("block") == F.col("block2"))).drop("row2", "block2")
    return joined.groupBy("row", "block").applyInArrow(inner, "row2 long, chunk2 int, entry string, leave string")


def encode_texts(docs: DataFrame, model_path: str, carry: list[Column], text_col: str = "text", size: int = CHUNK, back: str | None = None) -> DataFrame:
    """The columns in `carry` with `ids`, the library's ids of the whole text; with `back`, also the
    text that they decode to, under that name."""
    spark = docs.sparkSession
    small_batches(spark)
    codec(model_path).check()
    carried = docs.select(*carry).columns
    if taken := {"ids", back} & set(carried):
        raise ValueError(f"carried columns cannot be named {', '.join(sorted(taken))}")
    base = docs.select(F.struct(*carry).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    results = ["ids", *([back] if back else [])]
    kinds = {"ids": F.array().cast("array<int>"), back: F.lit("")}
    fields = base.select("doc", *[kinds[x].alias(x) for x in results]).schema

    def whole(batches):
        known = codec(model_path)
        for batch in batches:
            ids = known.library.encode(batch.column("text").to_pylist(), num_threads=1)
            texts = [pa.array([known.decode(x) if x else "" for x in ids], pa.string())] if back else []
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(ids, pa.list_(pa.int32())), *texts], ["doc", *results])

    usual = base.where(F.char_length("text") <= size).mapInArrow(tidy(whole), fields).select("doc.*", *results)
    giant = base.where(F.char_length("text") > size)
    work = Work(spark)
    giants = work.cut(giant.withColumn("giant", F.monotonically_increasing_id()), "giants")  # fixed when it is written
    if giants.isEmpty():
        work.drop(giants)
        return usual

    def split(batches):
        known = codec(model_path)
        for batch in batches:
            for row, text in zip(batch.column("giant").to_pylist(), batch.column("text").to_pylist()):
                for x in chunks_of(known, text, size):
                    yield pa.RecordBatch.from_pylist([x | {"row": row}], schema)

    schema = pa.schema([("row", pa.int64()), ("chunk", pa.int32()), ("text", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_())])
    chunks = work.cut(giants.select("giant", "text").mapInArrow(tidy(split), CHUNKS).repartition("row", "chunk"), "chunks")
    states = work.cut(states_of(chunks, model_path), "states")

    def traced(batches):
        known = codec(model_path)
        for batch in batches:
            ids = [known.trace(x["text"], x["start"], x["stop"], tuple(json.loads(x["entry"])), tuple(json.loads(x["leave"]))) for x in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), pa.array(ids, pa.list_(pa.int32()))], ["row", "chunk", "ids"])

    ready = chunks.join(states, (F.col("row") == F.col("row2")) & (F.col("chunk") == F.col("chunk2"))).drop("row2", "chunk2")
    parts = ready.mapInArrow(tidy(traced), "row long, chunk int, ids array<int>").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("x"))
    parts = parts.select("row", F.flatten(F.col("x.ids")).alias("ids"))
    done = work.cut(giants.drop("text").join(parts, F.col("giant") == F.col("row")).select("doc", "ids"), "giant-ids")
    work.drop(keep=(done,))
    done = (decode_ids(done, model_path, out_col=back) if back else done).select("doc.*", *results)
    return usual.unionByName(done)


def decode_ids(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """The frame with the text that its ids stand for (null ids: an empty text)."""
    small_batches(encoded.sparkSession)
    at = encoded.columns.index(ids_col)
    names = [*encoded.columns, out_col]

    def run(batches):
        known = codec(model_path)
        for batch in batches:
            texts = [known.decode(x) if x else "" for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return encoded.mapInArrow(tidy(run), encoded.withColumn(out_col, F.lit("")).schema)
