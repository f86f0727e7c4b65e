"""Log probabilities of texts under a hidden Markov model trained on the corpus, beside a unigram base.

Tokens of a text: its words, A-Z lower-cased, then one end. Counts of all tokens of the training documents are a table (it
grows with the corpus and is never gathered); only its most frequent `HEAD` rows go to the tasks.

The model. Latent states emit symbols: the `SYMBOLS` most frequent words, the end, and `CLASSES` classes of all other words
(by their first two letters). A word of a class has the probability of its class in the state times its own share in the
class, add-one smoothed with one place for unseen words, so probabilities of all texts add up to one. The states are
trained by Baum-Welch over all training documents: each task takes expected counts over its whole documents, the counts
are summed per symbol across tasks by an ordinary aggregation, and the driver, which sees one row per symbol, makes the
next parameters. Texts of more than `PART` symbols are taken in parts that know the state before and the weights behind
them, which gives the same counts as one long recursion. The start is made of a few distinct documents that
differ most, of any length; states left without one start from a seeded draw around the corpus.

Scoring is the exact forward recursion, scaled, over the whole text. Many texts advance together, step by step. Texts of
more than `PART` symbols are cut into parts, each run once from every state, and the parts' results are chained, which
gives the same number as one long recursion.

Counts of words outside the head are joined: these tokens are sent out by word and their logarithms summed per document.

Defined results: a null or empty text has the end only; without training documents all counts are 0 and the base is 0; a
null id counts as the empty text in `held_out`; repeated rows are scored each; ties of counts are ordered by word; empty
tables give an empty result; columns besides doc_id and text are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm import words
from linewright.llm.registry import query
from linewright.llm.shared import fold_of, staged

HEAD = 1 << 17
SYMBOLS = 1 << 15
CLASSES = 255
STATES = 8
PASSES = 6
PART = 2048
#: Parts that advance together, at most, and their symbols in training.
TOGETHER = 4096
AT_ONCE = 1 << 19
#: Documents that the start is made of.
STARTERS = 64
#: Weight, in tokens, of the corpus in the emissions of a state.
PRIOR = 200.0

ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, codes binary, rare array<string>"


def token_counts(docs: DataFrame) -> DataFrame:
    """token, c over all documents; the end is the empty token. docs: text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            _, flat = words.split(batch.column(0))
            found = flat.value_counts()
            tokens = pa.concat_arrays([found.field(0).cast(pa.large_string()), pa.array([""], pa.large_string())])
            counts = pa.concat_arrays([found.field(1), pa.array([batch.num_rows], pa.int64())])
            yield pa.RecordBatch.from_arrays([tokens.cast(pa.string()), counts], names=["token", "c"])

    return docs.select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def classes_of(distinct: pa.Array) -> np.ndarray:
    """The class of each word, as `class_column` has it."""
    import xxhash

    prefixes = pc.utf8_slice_codeunits(distinct, 0, 2).dictionary_encode()
    known = np.array([(h - (1 << 64) if (h := xxhash.xxh64_intdigest(p.encode(), 42)) >> 63 else h) % CLASSES for p in prefixes.dictionary.to_pylist()], np.int64)
    return known[prefixes.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.zeros(0, np.int64)


def class_column(token):
    return F.pmod(F.xxhash64(F.substring(token, 1, 2)), F.lit(CLASSES))


def encoder(sent, total: float, n_symbols: int):
    """mapInArrow function: doc_id, held_out, text -> ENCODED.

    sent: head words in order of count, their counts, count of the end, log10 of N_k + V_k + 1 per class. base: of the end
    and of the words in the head, for the others only the denominator; inside: the share of words in their class, likewise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, counts, c_end, log_class = sent.value
        head = pa.array(head, pa.large_string())
        log_count = np.log10(np.asarray(counts, float) + 1)
        for batch in words.slices(batches, "text"):
            n_words, flat = words.split(batch.column(2))
            codes, distinct = words.coded(flat)
            place = pc.fill_null(pc.index_in(distinct, value_set=head), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            group = classes_of(distinct)
            in_head = place >= 0
            own_log = np.where(in_head, log_count[np.maximum(place, 0)] if len(log_count) else 0.0, 0.0)
            is_symbol = in_head & (place < n_symbols)
            symbol = np.where(is_symbol, place + CLASSES + 1, group)
            inside = np.where(is_symbol, 0.0, own_log - np.asarray(log_class)[group])
            ends = np.concatenate([[0], np.cumsum(n_words)])

            def sums(values: np.ndarray, codes=codes, ends=ends) -> np.ndarray:
                c = np.concatenate([[0.0], np.cumsum(values[codes])]) if len(codes) else np.zeros(1)
                return c[ends[1:]] - c[ends[:-1]]

            n_head = sums(in_head.astype(float)).astype(np.int64)
            n_tokens = n_words + 1
            base = sums(own_log) + math.log10(c_end + 1) - n_tokens * math.log10(total)
            symbols = symbol[codes].astype("<u2")
            end = np.array([CLASSES], "<u2").tobytes()
            sequences = [symbols[a:b].tobytes() + end for a, b in zip(ends[:-1], ends[1:], strict=True)]
            out = ~in_head[codes]
            many = np.concatenate([[0], np.cumsum(out)])[ends]
            rare = pa.ListArray.from_arrays(pa.array(many, pa.int32()), flat.filter(pa.array(out)).cast(pa.string()))
            arrays = [batch.column(0), batch.column(1), pa.array(n_tokens), pa.array(n_head + int(c_end > 0)), pa.array(base), pa.array(sums(inside)), pa.array(sequences, pa.binary()), rare]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "codes", "rare"])

    return run


def expected(sequences: list[np.ndarray], start: np.ndarray, moves: np.ndarray, emits: np.ndarray, part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions (symbols x states) over whole sequences. emits: symbols x states."""
    pieces = [(s, None, np.ones(len(start))) for s in sequences if len(s) <= part]
    pieces += pieces_of([s for s in sequences if len(s) > part], start, moves, emits, part)
    pieces.sort(key=lambda p: -len(p[0]))
    sums = np.zeros(len(start)), np.zeros(moves.shape), np.zeros_like(emits)
    i = 0
    while i < len(pieces):
        n = max(1, min(TOGETHER, AT_ONCE // len(pieces[i][0])))
        for total, found in zip(sums, expected_of(pieces[i : i + n], start, moves, emits), strict=True):
            total += found
        i += n
    return sums


def pieces_of(sequences: list[np.ndarray], start: np.ndarray, moves: np.ndarray, emits: np.ndarray, part: int) -> list[tuple]:
    """Parts of sequences with what reaches them from the rest of their sequence.

    The distribution of the state before the part, given all symbols before it (None where the sequence starts), and the
    weights of the state at its end: up to a factor, the probability of all symbols after it.
    """
    placed, state, logs = run_parts(sequences, start, moves, emits, part)
    pieces = []
    for k, s in enumerate(sequences):
        offsets = range(0, len(s), part)
        froms = {i: [placed[k, i, j] for j in range(len(start))] for i in offsets[1:]}
        shares = {i: np.exp(logs[c] - logs[c].max()) for i, c in froms.items()}
        before, now = {}, state[placed[k, 0, -1]]
        for i in offsets[1:]:
            before[i] = now
            weights = now * shares[i]
            now = weights @ state[froms[i]] / weights.sum()
        after = np.ones(len(start))
        for i in reversed(offsets):
            pieces.append((s[i : i + part], before.get(i), after))
            if i:
                after = shares[i] * (state[froms[i]] @ after)
                after = after / after.max()
    return pieces


def expected_of(pieces: list[tuple], start: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same over pieces (see `pieces_of`) that advance together. pieces: the longest first."""
    n_states = len(start)
    starts, moved, emitted = np.zeros(n_states), np.zeros((n_states, n_states)), np.zeros_like(emits)
    sizes = np.array([len(p) for p, _, _ in pieces])
    steps = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # pieces longer than t
    ends = np.concatenate([[0], np.cumsum(active)])  # step t of piece k is row ends[t] + k
    symbols = np.empty(ends[-1], np.int64)
    for k, (p, _, _) in enumerate(pieces):
        symbols[ends[: len(p)] + k] = p
    goes_on = np.array([before is not None for _, before, _ in pieces])
    before = np.array([np.zeros(n_states) if b is None else b for _, b, _ in pieces])
    first = np.where(goes_on[:, None], before @ moves, start)
    ahead, scale = np.empty((len(symbols), n_states)), np.empty((len(symbols), 1))
    for t in range(steps):
        d, at = active[t], ends[t]
        a = (ahead[ends[t - 1] : ends[t - 1] + d] @ moves if t else first) * emits[symbols[at : at + d]]
        scale[at : at + d, 0] = 1 / (a @ np.ones(n_states))
        ahead[at : at + d] = a * scale[at : at + d]
    # scaled so that ahead * back adds up to one at the last symbol, which then holds at all of them
    back = np.array([after for _, _, after in pieces])
    back /= (ahead[ends[sizes - 1] + np.arange(len(pieces))] * back).sum(1, keepdims=True)
    for t in range(steps - 1, -1, -1):
        d, at = active[t], ends[t]
        if t + 1 < steps:
            e, then = active[t + 1], ends[t + 1]
            seen = emits[symbols[then : then + e]] * back[:e] * scale[then : then + e]
            moved += moves * (ahead[at : at + e].T @ seen)
            back[:e] = seen @ moves.T
        ahead[at : at + d] *= back[:d]
    seen = (emits[symbols[: len(pieces)]] * back * scale[: len(pieces)])[goes_on]
    moved += moves * (before[goes_on].T @ seen)
    starts += ahead[: len(pieces)][~goes_on].sum(0)
    for s in range(n_states):
        emitted[:, s] = np.bincount(symbols, ahead[:, s], len(emits))
    return starts, moved, emitted


def advanced(rows: list[np.ndarray], first: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distribution of the state at the end of each row, and the logarithm of its probability. rows: the longest first."""
    sizes = np.array([len(r) for r in rows])
    steps = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    symbols = np.zeros((steps, len(rows)), np.int32)
    for column, r in enumerate(rows):
        symbols[: sizes[column], column] = r
    state, logs = first.copy(), np.zeros(len(rows))
    for t in range(steps):
        d = active[t]
        a = (state[:d] @ moves if t else state[:d]) * emits[symbols[t, :d]]
        if t % 8 == 7:
            scale = a.sum(1)
            logs[:d] += np.log(scale)
            a /= scale[:, None]
        state[:d] = a
    total = state.sum(1)
    return state / total[:, None], logs + np.log(total)


def run_parts(sequences: list[np.ndarray], start: np.ndarray, moves: np.ndarray, emits: np.ndarray, part: int) -> tuple[dict, np.ndarray, np.ndarray]:
    """All parts of sequences, the first run once from the start (-1) and the others from every state before them.

    Returns the place of each (sequence, offset, state before), the states at the end and the logarithms, as `advanced` has them.
    """
    n_states = len(start)
    rows, firsts, owner = [], [], []
    for k, s in enumerate(sequences):
        for i in range(0, len(s), part):
            for state in range(n_states) if i else (-1,):
                rows.append(s[i : i + part])
                firsts.append(start if state < 0 else moves[state])
                owner.append((k, i, state))
    order = sorted(range(len(rows)), key=lambda r: -len(rows[r]))
    state, logs = np.empty((len(rows), n_states)), np.empty(len(rows))
    for i in range(0, len(order), TOGETHER):
        some = order[i : i + TOGETHER]
        state[i : i + TOGETHER], logs[i : i + TOGETHER] = advanced([rows[r] for r in some], np.array([firsts[r] for r in some]), moves, emits)
    return {owner[r]: column for column, r in enumerate(order)}, state, logs


def log_likelihoods(sequences: list[np.ndarray], start: np.ndarray, moves: np.ndarray, emits: np.ndarray, part: int = PART) -> np.ndarray:
    """Natural logarithms of the probabilities of whole sequences, by the scaled forward recursion."""
    n_states = len(start)
    placed, state, logs = run_parts(sequences, start, moves, emits, part)
    result = np.empty(len(sequences))
    for k, s in enumerate(sequences):
        column = placed[k, 0, -1]
        so_far, now = logs[column], state[column]
        for i in range(part, len(s), part):
            columns = [placed[k, i, j] for j in range(n_states)]
            most = logs[columns].max()
            weights = now * np.exp(logs[columns] - most)
            so_far += most + math.log(weights.sum())
            now = weights @ state[columns] / weights.sum()
        result[k] = so_far
    return result


def buffered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches with at most so many bytes of codes (or one row)."""
    return words.slices(batches, "codes", most)


def sequences_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u2") for b in column.to_pylist()]


def started(codes: list[np.ndarray], shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First parameters: each state leans to one of the documents, chosen so that each differs most from those before.

    States for which no other document is left are drawn around the corpus (seeded): equal states would stay equal.
    """
    seen = np.array([np.bincount(s, minlength=len(shares)) / len(s) for s in codes]).reshape(-1, len(shares))
    root = np.sqrt(seen)
    emits = np.tile(shares[:, None], (1, STATES))
    near = np.zeros(len(codes))
    for state in range(STATES):
        k = int(near.argmin()) if len(codes) else -1
        if k < 0 or near[k] > 1 - 1e-9:
            drawn = shares * np.exp(0.5 * np.random.default_rng(state).standard_normal(len(shares)))
            emits[:, state] = drawn / drawn.sum()
            continue
        near = np.maximum(near, root @ root[k])
        emits[:, state] = 0.5 * shares + 0.5 * seen[k]
    moves = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(moves, 0.9)
    return np.full(STATES, 1 / STATES), moves, emits


def starters(encoded: DataFrame) -> list[np.ndarray]:
    """Distinct texts that the start is made of, long ones by their first 2,000 symbols; those of under 100 come last."""
    stretch = F.substring("codes", 1, 4000)
    texts = encoded.select(stretch.alias("codes"), (F.octet_length("codes") < 200).alias("short"), F.xxhash64(stretch).alias("h"))
    keys = [r.h for r in texts.select("short", "h").distinct().orderBy("short", "h").limit(STARTERS).collect()]
    found = texts.where(F.col("h").isin(keys)).groupBy("short", "h").agg(F.min("codes").alias("codes")).orderBy("short", "h")
    return sequences_of(found.select("codes").toArrow().column(0))


def trained(encoded: DataFrame, shares: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, moves, emits of the model. encoded: doc_id, codes of the training documents; shares: of the symbols in the corpus."""
    context = encoded.sparkSession.sparkContext
    model = started(starters(encoded), shares)
    values = [f"s{s}" for s in range(STATES)]
    schema = "symbol int, " + ", ".join(f"{v} double" for v in values)
    for _ in range(passes):
        sent = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in buffered(batches, 1 << 21):
                found = expected(sequences_of(batch.column(0)), *sent.value)
                sums = found if sums is None else tuple(a + b for a, b in zip(sums, found, strict=True))
            if sums is not None:
                table = np.concatenate([sums[0][None, :], sums[1], sums[2]])
                used = np.flatnonzero(table.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(used - STATES - 1, pa.int32()), *(pa.array(table[used, s]) for s in range(STATES))], names=["symbol", *values])

        counted = encoded.select("codes").mapInArrow(run, schema).groupBy("symbol").agg(*(F.sum(v).alias(v) for v in values)).toArrow()
        table = np.zeros((1 + STATES + len(shares), STATES))
        table[counted.column(0).to_numpy() + STATES + 1] = np.stack([counted.column(1 + s).to_numpy() for s in range(STATES)], axis=1)
        start, moves, emits = table[0] + 1, table[1 : 1 + STATES] + 1, table[1 + STATES :] + PRIOR * shares[:, None]
        sent.unpersist()
        model = start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0)
    return model


def scored(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long"), (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "text")
    counts = staged(token_counts(docs.where("NOT held_out")), "token-counts")
    n_tokens, n_distinct, c_end = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("token") == "", F.col("c"))), F.lit(0))).first()
    head = counts.where("token <> ''").orderBy(F.desc("c"), "token").limit(HEAD).toArrow()
    c_head = head.column("c").to_numpy()
    symbols = min(SYMBOLS, len(c_head))
    # what the classes hold: all words but the symbols
    top = head.column("token").slice(0, symbols)
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.where("token <> ''").groupBy(class_column(F.col("token")).alias("k")).agg(F.sum("c"), F.count("*")).collect():
        n_class[r[0]], v_class[r[0]] = r[1], r[2]
    groups = classes_of(top.combine_chunks().cast(pa.large_string())) if symbols else np.zeros(0, np.int64)
    n_class -= np.bincount(groups, c_head[:symbols], CLASSES)
    v_class -= np.bincount(groups, minlength=CLASSES)
    shares = np.concatenate([n_class, [c_end], c_head[:symbols]]) + 1.0
    shares /= shares.sum()
    total = n_tokens + n_distinct + 1
    sent = context.broadcast((head.column("token").to_pylist(), c_head, int(c_end), np.log10(n_class + v_class + 1)))
    encoded = staged(docs.mapInArrow(encoder(sent, float(total), symbols), ENCODED).withColumn("row_no", F.monotonically_increasing_id()), "encoded")
    model = trained(encoded.where("NOT held_out"), shares)
    parameters = context.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in buffered(batches, 1 << 20):
            logs = log_likelihoods(sequences_of(batch.column(1)), *parameters.value) / math.log(10)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 2, 3, 4, 5, 6, 7)), pa.array(logs)], names=["row_no", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "log"])

    rows = encoded.select("row_no", "codes", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside").mapInArrow(
        run, "row_no long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, log double"
    )
    rare = encoded.select("row_no", F.explode("rare").alias("token")).join(counts.where("token <> ''"), "token")
    found = rare.groupBy("row_no").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("c") + 1)).alias("logs"))
    logs = F.coalesce("logs", F.lit(0.0))
    return rows.join(found, "row_no", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(n_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("log") + F.col("inside") + logs).alias("score"),
    )


@query("op9_lm_scoring")
def op9_lm_scoring(spark, sf_dir):
    """Unigram base and model log probability of every document."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), 7, 2)
