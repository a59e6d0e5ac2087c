"""A hidden Markov language model over whole documents.

Tokens are the words of the lower-cased (A-Z) text and one end. Word counts of all training documents are exact: tasks
number the words of blocks of documents, the (block, word) counts are summed by word and joined back to the blocks.

The model's symbols are the words with at least the share ``FREQUENT`` of all training tokens (so at most
1 / ``FREQUENT`` of them), the end, and ``CLASSES`` classes of rarer words by their first and last letters. Within a
class a word has its count less an absolute discount D, and the unknown words of that class together have what is
left; D = n1 / (n1 + 2 n2). So the model's outcomes, unknown words by class among them, have a total of one.

Hidden states are trained by Baum-Welch: in each round tasks run scaled forward-backward over chunks of all training
documents (a chunk that does not begin a document starts from a distribution of its own), their expected counts are
summed by symbol, and the new tables, of bounded size, go back to the tasks. The likelihood is exact for whole texts:
a chunk of a document becomes its scaled K x K transfer matrix, and the matrices are multiplied along the document.

Null text: only the end. Null id: scored, trained on as ``train`` says (null: not). Repeated rows: a row each, counted
each. No training documents: base score 0 per token over an empty vocabulary, and a uniform model.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqprep.llm.bpe import _field
from seqprep.llm.common import slices
from seqprep.scratch import scratch_folder

STATES, ROUNDS, FREQUENT, CLASSES, CHUNK, BLOCK_BYTES, STEP_TOKENS = 8, 8, 1e-4, 512, 128, 8 << 20, 1 << 17
LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
END = "\n"  # no word holds a line feed


def stored(df: DataFrame, label: str) -> DataFrame:
    path = f"{scratch_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def squeeze(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**32 as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unsqueeze(packed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def token_blocks(df: DataFrame, key: str, text: str, train: Column) -> DataFrame:
    """(_block, _keys, _train, _lengths, _ids, _words, _counts): documents of a block as numbers of its own words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", BLOCK_BYTES):
            number = defaultdict(count().__next__)
            number[END.encode()]
            learn = np.asarray(batch.column(2).fill_null(False)).astype(bool)
            ids, lengths = [], []
            for t in batch.column(1):
                words = (t.as_py() or "").encode().translate(LOWER).split()
                ids.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                ids.append(np.zeros(1, np.int32))
                lengths.append(len(words) + 1)
            ids, lengths = np.concatenate(ids), np.array(lengths)
            counts = np.bincount(ids[np.repeat(learn, lengths)], minlength=len(number))
            words = pa.ListArray.from_arrays(pa.array([0, len(number)], pa.int32()), pa.array([w.decode() for w in number], pa.string()))
            sums = pa.ListArray.from_arrays(pa.array([0, len(number)], pa.int32()), pa.array(counts, pa.int64()))
            keys = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            flags = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.array(learn))
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().int >> 65], pa.int64()), keys, flags, pa.array([squeeze(lengths)]), pa.array([squeeze(ids)]), words, sums],
                names=["_block", "_keys", "_train", "_lengths", "_ids", "_words", "_counts"],
            )

    narrow = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), train.alias("_learn"))
    kind = df.select(key).schema[0].dataType.simpleString()
    return narrow.mapInArrow(
        run, f"_block bigint, _keys array<{kind}>, _train array<boolean>, _lengths binary, _ids binary, _words array<string>, _counts array<bigint>"
    )


def vocabulary(blocks: DataFrame) -> tuple[DataFrame, dict, DataFrame]:
    """Per word its training count, symbol and log10 share within the symbol; the corpus totals; rows (block, place, word)."""
    words = blocks.select("_block", F.posexplode(F.arrays_zip("_words", "_counts")).alias("_place", "x")).select(
        "_block", "_place", F.col("x._words").alias("_word"), F.col("x._counts").alias("_n")
    )
    shape = F.pmod(F.crc32(F.concat(F.substring("_word", 1, 1), F.lit(" "), F.expr("right(_word, 2)"))), F.lit(CLASSES)).cast("int")
    counts = stored(words.groupBy("_word").agg(F.sum("_n").alias("c")).withColumn("_class", shape), "words")
    one = lambda v: F.count(F.when(F.col("c") == v, 1))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("N"), F.count(F.when(F.col("c") > 0, 1)).alias("V"), one(1).alias("n1"), one(2).alias("n2")).first().asDict()
    discount = total["n1"] / (total["n1"] + 2 * total["n2"]) if total["n1"] else 0.5
    common = (F.col("c") >= max(FREQUENT * total["N"], 5)) | (F.col("_word") == END)
    # at most 1 / FREQUENT words, whatever the corpus
    frequent = [r["_word"] for r in counts.where(common).orderBy(F.desc("c"), "_word").select("_word").collect()]
    spark = blocks.sparkSession
    known = spark.createDataFrame([(w, CLASSES + i) for i, w in enumerate(frequent)], "_word string, _symbol int")
    rare = counts.join(F.broadcast(known), "_word", "left")
    held = F.col("_symbol").isNull() & (F.col("c") > 0)
    classes = rare.where(held).groupBy("_class").agg(F.sum("c").alias("_mass"), F.count("*").alias("_types"))
    rare = rare.join(F.broadcast(classes), "_class", "left")
    mass, types = F.coalesce("_mass", F.lit(0)), F.coalesce("_types", F.lit(0))
    share = F.when(F.col("c") > 0, F.greatest(F.col("c") - discount, F.lit(1e-3))).otherwise(discount * types + 1) / (mass + 1)
    table = rare.select(
        "_word", "c", F.coalesce("_symbol", "_class").alias("_symbol"), F.when(F.col("_symbol").isNotNull(), 0.0).otherwise(F.log10(share)).alias("_inside")
    )
    total |= {"symbols": CLASSES + len(frequent), "end": CLASSES + frequent.index(END) if END in frequent else 0}
    return table, total, words.select("_block", "_place", "_word")


def symbol_blocks(blocks: DataFrame, table: DataFrame, total: dict, words: DataFrame, kind: str) -> DataFrame:
    """Blocks with the documents' base scores, known tokens, shares within symbols, and their symbols."""
    n, v = total["N"], total["V"]
    read = words.join(table, "_word").select(F.col("_block").alias("_of"), "_place", "c", "_symbol", "_inside")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        by = np.argsort(np.asarray(right.column("_place")))
        c, symbol, inside = (np.asarray(right.column(x))[by] for x in ("c", "_symbol", "_inside"))
        base = np.log10((c + 1.0) / (n + (v + 1.0)))
        ids, lengths = unsqueeze(left.column("_ids")[0].as_py()), unsqueeze(left.column("_lengths")[0].as_py())
        start = np.cumsum(lengths) - lengths
        per = lambda x: np.add.reduceat(x[ids], start)
        lists = lambda x, t: pa.array([list(x)], pa.list_(t))
        return pa.table({
            "_keys": left.column("_keys"), "_train": left.column("_train"), "_lengths": left.column("_lengths"), "_symbols": pa.array([squeeze(symbol[ids])]),
            "_known": lists(per((c > 0).astype(np.int64)), pa.int64()), "_base": lists(per(base), pa.float64()), "_inside": lists(per(inside), pa.float64()),
        })

    whole = blocks.select("_block", "_keys", "_train", "_lengths", "_ids")
    return whole.groupBy("_block").cogroup(read.groupBy("_of")).applyInArrow(
        run, f"_keys array<{kind}>, _train array<boolean>, _lengths binary, _symbols binary, _known array<bigint>, _base array<double>, _inside array<double>"
    )


def chunks(lengths: np.ndarray, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, length, document and number within it of each chunk."""
    per = -(-lengths // size)
    doc = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = np.repeat(np.cumsum(lengths) - lengths, per) + nth * size
    return start, np.minimum(size, lengths[doc] - nth * size), doc, nth


def _steps(start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks by falling length, in parts of a bounded number of tokens, with the number of live chunks at each step."""
    order = np.argsort(-length, kind="stable")
    part = max(1, STEP_TOKENS // max(1, int(length.max()))) if len(length) else 1
    for at in range(0, len(order), part):
        mine = order[at : at + part]
        longest = length[mine]
        yield mine, np.searchsorted(-longest, -np.arange(longest[0]), "left")


def expected_counts(symbols: np.ndarray, lengths: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected emissions, transitions, document starts and chunk starts, and the chunks' log likelihood."""
    a, b, k = model["move"], model["emit"], len(model["move"])
    emissions, moves, firsts, log, ones = np.zeros_like(b), np.zeros_like(a), np.zeros((2, k)), 0.0, np.ones(k)
    start, length, _, nth = chunks(lengths)
    for mine, live in _steps(start, length):
        begin, later = start[mine], (nth[mine] > 0).astype(int)
        width = len(live)
        alpha, e, scale = np.zeros((width, len(mine), k)), np.ones((width, len(mine), k)), np.ones((width, len(mine)))
        for t, n in enumerate(live):
            e[t, :n] = b[symbols[begin[:n] + t]]
            x = (model["start"][later[:n]] if t == 0 else alpha[t - 1, :n] @ a) * e[t, :n]
            scale[t, :n] = s = x @ ones
            np.divide(x, s[:, None], out=alpha[t, :n])
        log += float(np.log(scale).sum())
        beta = np.ones((len(mine), k))
        for t in range(width - 1, -1, -1):
            n = live[t]
            # forward and scaled backward messages multiply to one per token
            gamma = alpha[t, :n] * beta[:n]
            alpha_before = alpha[t - 1, :n] if t else None
            if t:
                x = beta[:n] * e[t, :n] / scale[t, :n, None]
                moves += (alpha_before.T @ x) * a
                beta[:n] = x @ a.T
            else:
                for j in (0, 1):
                    firsts[j] += gamma[later[:n] == j].sum(axis=0)
            alpha[t, :n] = gamma
        flat = np.concatenate([symbols[begin[:n] + t] for t, n in enumerate(live)])
        gamma = np.concatenate([alpha[t, :n] for t, n in enumerate(live)])
        for j in range(k):
            emissions[:, j] += np.bincount(flat, weights=gamma[:, j], minlength=len(b))
    return emissions, moves, firsts, log


def likelihood(symbols: np.ndarray, lengths: np.ndarray, model: dict) -> np.ndarray:
    """Natural log probability of each document's symbols, by transfer matrices of its chunks."""
    a, b, k = model["move"], model["emit"], len(model["move"])
    start, length, doc, nth = chunks(lengths)
    matrix, logs, ones = np.zeros((len(start), k, k)), np.zeros(len(start)), np.ones(k * k)
    for mine, live in _steps(start, length):
        begin = start[mine]
        m = np.where((nth[mine] == 0)[:, None, None], np.eye(k), a)
        m *= b[symbols[begin]][:, None, :]
        total = np.zeros(len(mine))
        for t, n in enumerate(live):
            if t:
                m[:n] = (m[:n].reshape(-1, k) @ a).reshape(n, k, k) * b[symbols[begin[:n] + t]][:, None, :]
            s = m[:n].reshape(n, -1) @ ones
            m[:n] /= s[:, None, None]
            total[:n] += np.log(s)
        matrix[mine], logs[mine] = m, total
    per = np.bincount(doc, minlength=len(lengths))
    first, order = np.cumsum(per) - per, np.argsort(-per, kind="stable")
    state, out = np.tile(model["start"][0], (len(lengths), 1)), np.bincount(doc, weights=logs, minlength=len(lengths))
    for j in range(int(per.max()) if len(per) else 0):
        now = order[: np.searchsorted(-per[order], -j, "left")]
        state[now] = np.einsum("nk,nkl->nl", state[now], matrix[first[now] + j])
        s = state[now].sum(axis=1)
        out[now] += np.log(s)
        state[now] /= s[:, None]
    return out


def first_model(symbols: int, states: int, seed: int = 11) -> dict:
    rng = np.random.default_rng(seed)
    emit = np.exp(rng.normal(0, 1, (symbols, states)))
    move = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1))
    return {"emit": emit / emit.sum(axis=0), "move": move / move.sum(axis=1, keepdims=True), "start": np.full((2, states), 1 / states)}


def train(blocks: DataFrame, symbols: int, states: int = STATES, rounds: int = ROUNDS, smoothing: float = 0.01) -> dict:
    """Baum-Welch over the training documents of all blocks."""
    spark, model = blocks.sparkSession, first_model(symbols, states)
    columns = [f"s{j}" for j in range(states)]
    narrow = blocks.select("_train", "_lengths", "_symbols")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            emissions, moves, firsts = np.zeros_like(m["emit"]), np.zeros_like(m["move"]), np.zeros((2, states))
            for batch in batches:
                for learn, lengths, packed in zip(*(c.to_pylist() for c in batch.columns)):
                    learn, lengths = np.array(learn, bool), unsqueeze(lengths)
                    if learn.any():
                        found = expected_counts(unsqueeze(packed)[np.repeat(learn, lengths)], lengths[learn], m)
                        emissions, moves, firsts = emissions + found[0], moves + found[1], firsts + found[2]
            used = np.flatnonzero(emissions.any(axis=1))
            rows = np.vstack([emissions[used], moves, firsts])
            name = np.concatenate([used, -1 - np.arange(states + 2)])
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), *(pa.array(rows[:, j]) for j in range(states))], names=["symbol", *columns])

        counts = narrow.mapInArrow(run, "symbol bigint, " + ", ".join(f"{c} double" for c in columns))
        summed = counts.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in columns]).collect()
        emit, rest = np.full((symbols, states), smoothing), np.zeros((states + 2, states))
        for row in summed:
            if row[0] >= 0:
                emit[row[0]] += row[1:]
            else:
                rest[-1 - row[0]] = row[1:]
        move, start = rest[:states] + 0.1, rest[states:] + 0.1
        model = {"emit": emit / emit.sum(axis=0), "move": move / move.sum(axis=1, keepdims=True), "start": start / start.sum(axis=1, keepdims=True)}
    return model


def score_documents(df: DataFrame, key: str, text: str, train_on: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(key, trained, n_tokens, n_known, train_tokens, base_score, score): one row per input row, scores in log10."""
    kind = df.select(key).schema[0].dataType.simpleString()
    blocks = stored(token_blocks(df, key, text, train_on), "tokens")
    table, total, words = vocabulary(blocks)
    coded = stored(symbol_blocks(blocks, table, total, words, kind), "symbols")
    model = train(coded, total["symbols"], states, rounds)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                lengths = unsqueeze(row["_lengths"].as_py())
                log = likelihood(unsqueeze(row["_symbols"].as_py()), lengths, shared.value) / np.log(10)
                yield pa.RecordBatch.from_arrays(
                    [row["_keys"].values, row["_train"].values, pa.array(lengths, pa.int64()), row["_known"].values,
                     pa.array(np.full(len(lengths), total["N"]), pa.int64()), row["_base"].values, pa.array(log + np.asarray(row["_inside"].values))],
                    names=[key, "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return coded.mapInArrow(run, f"{_field(df, key)}, trained boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
