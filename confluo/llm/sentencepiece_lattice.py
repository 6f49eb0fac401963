"""SentencePiece encoding and decoding: a relational lattice over the distinct units of the corpus, folded by Viterbi."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from confluo.llm._base import document_key, give_back, prefix_hash, slices, span_hash
from confluo.storage import materialize

MARK = "▁"
#: The path of a longer unit is folded place by place in Arrow batches: the relational fold copies its state at each.
LONGEST = 1024
#: A node of the fold is one long: cost, then how much shorter than 63 its last piece is, then the piece's id.
_ID, _SHORT = 19, 6
_NO_PIECE = (1 << _ID) - 1
_COST, _RANKS = 28, 25
#: Workers put together and spell out about this many ids at a time, or one document: they share an executor with the JVM.
_SOME = 1 << 16
#: Stands for a mark that is no space: no unit of a text can look like this.
_LITERAL = "\x00" + MARK


def piece_table(model_file: str) -> tuple[list[tuple[str, int, int]], int, int]:
    """(piece, id, cost) of the pieces that text can match, the cost of a character that no piece covers, and the id of byte 0.

    A path's cost is the sum of its pieces' costs. Log probabilities count in steps of 1/4096, and an uncovered character costs ten more than the worst piece. The scores of a
    BPE model are ranks of merges and no log probabilities: their sums would prefer many frequent scraps, so there paths of
    fewest pieces come first, then those of best ranks. A cost is then a number of pieces above ``_RANKS`` bits and a rank below: a character counts as four pieces, and
    pieces of a score of -1e9 (runs of spaces) as two.
    """
    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = m.get_piece_size()
    zero = next((i for i in range(n) if m.id_to_piece(i) == "<0x00>"), -1)
    plain = [(m.id_to_piece(i), i, m.get_score(i)) for i in range(n) if m.id_to_piece(i) and not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    if all(score == int(score) for _, _, score in plain):
        split = [divmod(10**9 - int(score), 10**9) for _, _, score in plain]
        rows, other = [(p, i, n << _RANKS | rank) for (p, i, _), (n, rank) in zip(plain, split, strict=True)], 4 << _RANKS
        if max(rank for _, rank in split) * LONGEST >= 1 << _RANKS:
            raise ValueError("the model has ranks beyond the lattice's range")
    else:
        rows = [(p, i, round(-4096 * score)) for p, i, score in plain]
        other = max(cost for _, _, cost in rows) + 40960
    if any(not 0 <= c < 1 << _COST for c in (other, *(r[2] for r in rows))) or n > _NO_PIECE or any(len(r[0]) > 63 for r in rows):
        raise ValueError("the model has scores, ids or pieces beyond the lattice's range")
    return rows, other, zero


def lattice(units: DataFrame, rows: list[tuple[str, int, int]], other: int) -> DataFrame:
    """``unit, ids``: the cheapest path of each distinct unit. A negative id -1-c is the character c, which no piece covers.

    Substrings are exploded, up to the longest piece that begins as they do, and joined to the piece table, which is of fixed size; edges are
    gathered by unit in place, as units are already dealt by unit. The fold appends the best edge into each place: least cost,
    then the longer last piece, then the smaller id. Edges come by the place they end at, the one of a single character last.
    """
    spark = units.sparkSession
    pieces = spark.createDataFrame([(p, cost << (_ID + _SHORT) | (63 - len(p)) << _ID | i) for p, i, cost in rows], "piece string, node long")
    far: dict[str, int] = {}
    for p, _, _ in rows:
        if len(p) > 3:
            far[p[:3]] = max(far.get(p[:3], 0), len(p))
    heads = spark.createDataFrame(sorted(far.items()), "head string, far int")
    starts = units.select("unit", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("s"))
    starts = starts.withColumn("head", F.substring("unit", F.col("s"), F.lit(3))).join(F.broadcast(heads), "head", "left")
    last = F.least(F.coalesce("far", F.lit(3)), F.length("unit") - F.col("s") + 1)
    subs = starts.select("unit", "s", F.explode(F.sequence(F.lit(1), last)).alias("l"))
    subs = subs.select("unit", (F.col("s") - 1 + F.col("l")).alias("b"), "l", F.substring("unit", F.col("s"), F.col("l")).alias("piece"))
    joined = subs.join(F.broadcast(pieces), "piece", "left").where("node is not null or l = 1")
    uncovered = F.lit(other << (_ID + _SHORT) | 62 << _ID | _NO_PIECE)
    edge = F.struct("b", (-F.col("l")).alias("back"), F.coalesce("node", uncovered).alias("node"))
    grouped = joined.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))

    none = F.lit((1 << 63) - 1)

    def step(s: Column, x: Column) -> Column:
        made = F.least(s["now"], F.element_at(s["best"], x["back"]).bitwiseAND(F.lit(-1 << (_ID + _SHORT))) + x["node"])
        place = F.struct(F.concat(s["best"], F.array(made)).alias("best"), none.alias("now"))
        return F.when(x["back"] == -1, place).otherwise(F.struct(s["best"].alias("best"), made.alias("now")))

    zero = F.struct(F.array(F.lit(0).cast("long")).alias("best"), none.alias("now"))
    folded = grouped.select("unit", F.aggregate("edges", zero, step, lambda s: s["best"]).alias("best"))

    def back(acc: Column, _: Column) -> Column:
        node = F.get("best", acc["at"])
        id_ = node.bitwiseAND(F.lit(_NO_PIECE)).cast("int")
        id_ = F.when(id_ == _NO_PIECE, -1 - F.ascii(F.substring("unit", acc["at"], F.lit(1)))).otherwise(id_)
        before = acc["at"] - 63 + F.shiftright(node, _ID).bitwiseAND(F.lit(63)).cast("int")
        return F.when(acc["at"] > 0, F.struct(before.alias("at"), F.concat(acc["ids"], F.array(id_)).alias("ids"))).otherwise(acc)

    start = F.struct((F.size("best") - 1).alias("at"), F.array().cast("array<int>").alias("ids"))
    return folded.select("unit", F.reverse(F.aggregate(F.sequence(F.lit(2), F.size("best")), start, back)["ids"]).alias("ids"))


def _long_paths(rows: list[tuple[str, int, int]], other: int):
    """As ``lattice``, for long units: each place in order, in time and memory that grow with the length."""
    longest, ranks = max((len(p) for p, _, _ in rows), default=1), other == 4 << _RANKS

    def run(batches):
        # wider than in a long, so that no sum of ranks reaches the number of pieces
        wide = (lambda c: (c >> _RANKS) << 64 | c & ((1 << _RANKS) - 1)) if ranks else int
        pieces, plain = {p: (i, wide(cost)) for p, i, cost in rows}, wide(other)
        for batch in batches:
            for t in batch.column("unit").to_pylist():
                best, back, ids = [0], [0], [0]
                for b in range(1, len(t) + 1):
                    now = None
                    for a in range(max(0, b - longest), b):
                        got = pieces.get(t[a:b]) or ((-1 - ord(t[a]), plain) if b - a == 1 else None)
                        if got and (now is None or best[a] + got[1] < now[0]):
                            now = (best[a] + got[1], a, got[0])
                    for x, y in zip((best, back, ids), now, strict=True):
                        x.append(y)
                path, at = [], len(t)
                while at:
                    path.append(ids[at])
                    at = back[at]
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.string()), pa.array([path[::-1]], pa.list_(pa.int32()))], names=["unit", "ids"])

    return run


class Cutter:
    """Cuts texts between any two characters that stand side by side in no piece: no path can cross there."""

    def __init__(self, pieces: list[str]):
        pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        chars = sorted({c for x in pairs for c in x})
        number = {c: i + 1 for i, c in enumerate(chars)}
        self.index = np.zeros(0x110001, np.int16)
        self.index[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for x in pairs:
            self.joined[number[x[0]], number[x[1]]] = True

    def cut(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct units of the texts, the units of all texts as numbers of these, and how many each text has.

        Spaces count as marks and one more stands before the text. A mark that is no space is a unit of its own, ``_LITERAL``.
        """
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        off = np.append(0, np.cumsum(size))
        code = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        if not len(code):
            return [], np.zeros(0, np.int64), size
        code[code == ord(MARK)] = 0x110000
        code[code == 32] = ord(MARK)
        kind = self.index[code]
        head = np.append(True, ~self.joined[kind[:-1], kind[1:]])
        head[off[:-1][size > 0]] = True
        a = np.flatnonzero(head)
        b = np.append(a[1:], len(code))
        plain = code.copy()
        plain[code == 0x110000] = ord(MARK)
        whole = plain.tobytes().decode("utf-32-le", "surrogatepass")
        _, first, number = np.unique(span_hash(prefix_hash(code), a, b), return_index=True, return_inverse=True)
        same = first[number]
        shift = np.repeat(a[same] - a, b - a)
        if (b - a != b[same] - a[same]).any() or (code[np.arange(len(code)) + shift] != code).any():  # equal hashes of unlike units
            known: dict[str, int] = {}
            number = np.array([known.setdefault(_LITERAL if code[x] == 0x110000 else whole[x:y], len(known)) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            units = list(known)
        else:
            units = [_LITERAL if c == 0x110000 else whole[x:y] for x, y, c in zip(a[first].tolist(), b[first].tolist(), code[a[first]].tolist(), strict=True)]
        return units, number, np.diff(np.searchsorted(a, off))


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers, compressed byte by byte: all lowest bytes first."""
    cells = x.astype("<i4", copy=False).view(np.uint8)
    packer = zstandard.ZstdCompressor(level=3).compressobj(size=len(cells))
    return b"".join([*(packer.compress(cells[i::4].tobytes()) for i in range(4)), packer.flush()])


def _from_planes(b: pa.Buffer) -> np.ndarray:
    n = zstandard.get_frame_parameters(b).content_size // 4
    out = np.empty((n, 4), np.uint8)
    plane = np.empty(n, np.uint8)
    with zstandard.ZstdDecompressor().stream_reader(b) as reader:
        for i in range(4):
            got = 0
            while got < n:
                more = reader.readinto(plane[got:].data)
                if not more:
                    raise RuntimeError("packed numbers end early")
                got += more
            out[:, i] = plane
    return out.view("<i4").ravel()


def _stretches(sizes: np.ndarray):
    """Neighbouring documents, from and to: 64, of about ``_SOME`` ids, or one of any size."""
    ends, i = np.cumsum(sizes, dtype=np.int64), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _SOME, "right")))
        j = min(j, i + 64)
        yield i, j
        i = j


class Speller:
    """The texts of arrays of ids: pieces end to end, marks as spaces but for the first, byte ids as UTF-8."""

    def __init__(self, model_file: str):
        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        table = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) or m.is_unknown(i) else m.id_to_piece(i).replace(MARK, " ").encode() for i in range(m.get_piece_size())]
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.size = np.array([len(x) for x in table], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def texts(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """sizes: how many ids each document has."""
        out = []
        ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
        for i, j in _stretches(sizes):
            raw, to, total = [], [np.zeros(1, np.int64)], 0
            # a long document takes several turns
            for a in range(ends[i], ends[j], _SOME):
                got = ids[a : min(a + _SOME, ends[j])]
                n = self.size[got]
                upto = np.cumsum(n)
                raw.append(self.flat[np.repeat(self.first[got] - (upto - n), n) + np.arange(upto[-1])].tobytes())
                to.append(upto + total)
                total += int(upto[-1])
            whole = b"".join(raw)
            at = np.concatenate(to)[ends[i : j + 1] - ends[i]].tolist()
            for a, b in zip(at[:-1], at[1:], strict=True):
                text = whole[a:b]
                out.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "replace"))
        return out


def _pack(pieces: list[str], part_bytes: int):
    """Documents by the part: a row of place -1 with their units as numbers, and one for each distinct unit, which asks for its path."""

    def run(batches):
        cutter = Cutter(pieces)
        numbers: dict[str, int] = {}
        names, seq, counts, held = [], bytearray(), [], 0

        def flush():
            flat = np.frombuffer(seq, np.int32)
            order = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")
            place = np.empty(len(numbers), np.int32)
            place[order] = np.arange(len(numbers))
            np.take(place, flat, out=flat)
            keys = pa.concat_arrays(names)
            part = pa.scalar(int.from_bytes(hashlib.blake2b(repr(keys.to_pylist()).encode(), digest_size=8).digest(), "little", signed=True), pa.int64())
            kind = pa.list_(keys.type)
            head = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys).cast(kind)
            body = pa.array([_planes(flat)], pa.binary())
            del flat, order
            give_back()
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(part, 1), pa.array([-1], pa.int32()), pa.nulls(1, pa.string()), head, body, pa.array([_planes(np.concatenate(counts))], pa.binary())],
                names=["part", "place", "unit", "names", "body", "counts"],
            )
            units = sorted(numbers)
            for i in range(0, len(units), 1 << 13):
                some = units[i : i + (1 << 13)]
                n = len(some)
                at = place[np.fromiter((numbers[u] for u in some), np.int64, n)]
                yield pa.RecordBatch.from_arrays([pa.repeat(part, n), pa.array(at), pa.array(some, pa.string()), pa.nulls(n, kind), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=["part", "place", "unit", "names", "body", "counts"])

        for batch in batches:
            for piece in slices([batch], limit=1 << 18):
                units, number, n = cutter.cut(piece.column("text").to_pylist())
                known = np.fromiter((numbers.setdefault(u, len(numbers)) for u in units), np.int32, len(units))
                names.append(piece.column("rk"))
                seq.extend(known[number].data)
                counts.append(n)
                held += piece.column("text").nbytes
                if held >= part_bytes:
                    yield from flush()
                    numbers, names, seq, counts, held = {}, [], bytearray(), [], 0
            give_back()
        if names:
            yield from flush()
        numbers, names, seq, counts = {}, [], bytearray(), []
        give_back()

    return run


def _gather():
    """Rows come sorted by part: the places, sizes and ids of the answers to a part, in columns of bytes."""

    def run(batches):
        part, held = None, []

        def out():
            place, size, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(place, kind="stable")
            n = size[order]
            at = (np.cumsum(size) - size)[order]
            ids = ids[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            planes = [pa.array([_planes(x)], pa.binary()) for x in (np.diff(place[order], prepend=0), n, ids)]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *planes], names=["part", "places", "sizes", "ids"])

        for batch in batches:
            parts, places, ids = batch.column("part").to_numpy(), batch.column("place").to_numpy(), batch.column("ids")
            if ids.null_count:
                raise RuntimeError("a unit has no path")
            cut = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else []
            for a, b in zip(cut, np.append(cut[1:], len(parts)), strict=True):
                if parts[a] != part:
                    if held:
                        yield out()
                    part, held = int(parts[a]), []
                some = ids.slice(int(a), int(b - a))
                held.append((places[a:b], np.diff(some.offsets.to_numpy()).astype(np.int64), some.flatten().to_numpy()))
        if held:
            yield out()
        held = []
        give_back()

    return run


def _assemble(zero: int, speller: Speller | None = None):
    """A row is a part with the answers to it: the ids of each document, and with a speller their text."""

    def spelled(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that no piece covers as the ids of their bytes."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, n
        made = [np.array([zero + b for b in chr(-1 - x).encode("utf-8", "replace")], np.int32) for x in ids[odd].tolist()]
        size = np.ones(len(ids), np.int64)
        size[odd] = [len(x) for x in made]
        out = np.repeat(ids, size)
        at = np.cumsum(size) - size
        out[np.concatenate([np.arange(p, p + len(x)) for p, x in zip(at[odd].tolist(), made, strict=True)])] = np.concatenate(made)
        total = np.append(0, np.cumsum(size))
        ends = np.append(0, np.cumsum(n))
        return out, np.diff(total[ends])

    def run(batches):
        def out(names, seq, counts, replies):
            units = int(seq.max()) + 1 if len(seq) else 0
            n, at, base = np.full(units, -1, np.int64), np.zeros(units, np.int64), 0
            for places, sizes, ids in replies:
                n[places], at[places] = sizes, np.cumsum(sizes) - sizes + base
                base += len(ids)
            if (n < 0).any():
                raise RuntimeError("a part has lost some of its units")
            flat = np.concatenate([r[2] for r in replies]) if replies else np.zeros(0, np.int32)
            ends = np.cumsum(counts, dtype=np.int64)
            for i, j in _stretches(counts):
                lo, hi = (ends[i - 1] if i else 0), ends[j - 1]
                u = seq[lo:hi]
                size = n[u]
                total = np.append(0, np.cumsum(size))
                got = flat[np.repeat(at[u] - total[:-1], size) + np.arange(total[-1])].astype(np.int32, copy=False)
                off = np.append(0, total[ends[i:j] - lo])
                cells = [names.slice(i, j - i), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(got))]
                yield pa.RecordBatch.from_arrays([*cells, pa.array(speller.texts(got, np.diff(off)), pa.string())] if speller else cells, names=["rk", "ids", "decoded"][: 2 + bool(speller)])

        for batch in batches:
            for i in range(batch.num_rows):
                names, body, counts, answers = (batch.column(c)[i] for c in ("names", "body", "counts", "answers"))
                replies = []
                for answer in answers.values or () if answers.is_valid else ():
                    sizes, ids = (_from_planes(answer[c].as_buffer()) for c in ("sizes", "ids"))
                    ids, sizes = spelled(ids, sizes.astype(np.int64))
                    replies.append((np.cumsum(_from_planes(answer["places"].as_buffer())), sizes, ids))
                yield from out(names.values, _from_planes(body.as_buffer()), _from_planes(counts.as_buffer()), replies)
                replies = []
                give_back()

    return run


def encode(docs: DataFrame, model_file: str, part_bytes: int = 32 << 20, texts: bool = False) -> DataFrame:
    """``doc_id, ids`` of each row of docs (``doc_id, text``): the cheapest path through the piece table.

    texts: a column ``decoded`` more, what ``decode`` makes of the ids. The workers that put the ids together spell them out, so that a task needs
    no second worker for it.

    Spaces count as the mark that pieces have for them, one more stands before the text; a character that no piece covers
    becomes its UTF-8 bytes' ids. Texts are cut where no piece of the table can cross (``Cutter``), so the lattice is built once for each distinct unit of the corpus.
    Documents travel as numbers of units, in parts of about ``part_bytes`` of text; a part asks once for each of its
    units and is put together from the answers. For a BPE model the paths are those of fewest pieces (``piece_table``), not the
    library's merges; ids therefore differ from the library's, and decode to the same text.

    Null and empty texts give no ids. Units of any length are encoded whole. Repeated rows each get
    their result; null doc_ids too. No rows: no rows.
    """
    spark = docs.sparkSession
    rows, other, zero = piece_table(model_file)
    key = document_key(docs)
    whole = docs.select(key.alias("rk"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rk = whole.schema["rk"].dataType.simpleString()
    if rk != "bigint":
        whole = whole.dropDuplicates(["rk"])
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = f"part long, place int, unit string, names array<{rk}>, body binary, counts binary"
    packed = materialize(whole.select("rk", "text").mapInArrow(_pack([p for p, _, _ in rows], part_bytes), schema), buckets=(buckets, "part"))
    # one exchange by unit serves the lattice and the answers: all three branches read the same columns; many small tasks, as a task's edges are sorted in memory
    asked = packed.where("place >= 0 and unit is not null").select("part", "place", "unit").repartition(4 * buckets, "unit")
    units = asked.groupBy("unit").agg(F.max("part").alias("part"), F.max("place").alias("place"), F.max(F.when(F.col("unit") == _LITERAL, 0).otherwise(F.length("unit"))).alias("n")).where("part is not null and place >= 0")
    short = lattice(units.where(F.col("n").between(1, LONGEST)).select("unit"), rows, other)
    long = units.where(F.col("n") > LONGEST).select("unit").mapInArrow(_long_paths(rows, other), "unit string, ids array<int>").withColumnRenamed("ids", "long_ids")
    answers = asked.join(short.hint("shuffle_hash"), "unit", "left").join(long.hint("shuffle_hash"), "unit", "left")
    ids = F.coalesce("ids", "long_ids", F.when(F.col("unit") == _LITERAL, F.array(F.lit(-1 - ord(MARK)))))
    replies = answers.select("part", "place", ids.alias("ids")).sortWithinPartitions("part").mapInArrow(_gather(), "part long, places binary, sizes binary, ids binary")
    replies = replies.groupBy("part").agg(F.collect_list(F.struct("places", "sizes", "ids")).alias("answers"))
    heads = packed.where("place < 0").select("part", "names", "body", "counts")
    results, speller = (["ids", "decoded"], Speller(model_file)) if texts else (["ids"], None)
    out = heads.join(replies, "part", "left").select("names", "body", "counts", "answers").mapInArrow(_assemble(zero, speller), f"rk {rk}, ids array<int>" + ", decoded string" * texts)
    if rk != "bigint":
        return docs.select(key.alias("rk"), "doc_id").join(out, "rk").select("doc_id", *results)
    return out.select(F.col("rk").alias("doc_id"), *results)


def decode(ids: Column, model_file: str) -> Column:
    """The text of an array of ids: pieces end to end, marks as spaces but for the first, byte ids as UTF-8. Null for null."""
    speller = Speller(model_file)

    @arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        made = pa.array(speller.texts(col.flatten().to_numpy(), col.value_lengths().fill_null(0).to_numpy()), pa.string(), mask=col.is_null().to_numpy(zero_copy_only=False))
        give_back()
        return made

    return run(ids)


def default_model(spark: SparkSession) -> str:
    """The public 32k model; the setting ``confluo.tokenizer.model`` names another."""
    return spark.conf.get("confluo.tokenizer.model", "/opt/tokenizers/piece_bpe_32k.model")
