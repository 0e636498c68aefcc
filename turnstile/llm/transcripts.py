"""Transcript parsing with a hidden Markov model (operator 8).

A transcript is a numbered list of lines. Each line has features: the kind of speaker marker it begins with, its
length, how it ends. A hidden state is a role and a part of a turn (its first line, a further line, the gap behind it).
Emission and transition probabilities are counted on labelled transcripts; the most likely states of a transcript
are found by Viterbi's recursion; turns are read off and rendered in one canonical form.

A transcript is dealt in chunks of SPAN line numbers (turns, where lines are numbered within turns); where these have more than
MOST lines, each turn is cut after every MOST places of its own. So no chunk has more than MOST lines, unless more share one number and
place. A chunk's best scores between all pairs of states make a matrix; the matrices of a transcript, one small row a chunk, are folded
to find the states at the chunks' ends, and the chunks are then decoded on their own. The result is that of one pass over the whole
transcript.

Cases: a null line counts as empty; lines with the same number are ordered by their place within it (``at``, if there is one), then by
their text, where a null place counts as 0; a null conv_id is a transcript of its own. Numbers may be negative and of any size; a null one counts as 0. A transcript of
blank lines only has no turn. Without labelled lines probabilities are uniform.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

ROLES = ("system", "user", "assistant")
BEGIN, INSIDE, GAP = 0, 1, 2
STATES = 3 * len(ROLES)
#: Fixed names that speaker markers use, by role; a marker is a name with a colon or behind number signs.
NAMES = {"system": "system|instructions?|context", "user": "user|human|question|customer|q", "assistant": "assistant|ai|bot|answer|model|a"}
MARKER = r"(?i)^\s*(?:#+\s*({0})\s*:?\s*$|[*_]*({0})[*_]*\s*:\s*)"
ANY = MARKER.format("|".join(NAMES[r] for r in ROLES))
#: Values of each feature: marker (none, by role, some other name), words, end.
VALUES = (5, 5, 5)
#: Line numbers that a chunk spans, and lines that it has at most.
SPAN, MOST = 64, 4096
BLANK = " \t\n\x0b\f\r"


def features(line: Column) -> list[Column]:
    marker = F.when(line.rlike(r"^\s*\w[\w ]{0,20}:(\s|$)"), 4).otherwise(0)
    for i, role in reversed(list(enumerate(ROLES))):
        marker = F.when(line.rlike(MARKER.format(NAMES[role])), i + 1).otherwise(marker)
    words = F.size(F.split(F.trim(line), r"\s+"))
    size = F.when(F.trim(line) == "", 0).when(words <= 3, 1).when(words <= 12, 2).when(words <= 40, 3).otherwise(4)
    end = F.when(F.trim(line) == "", 0).when(line.rlike(r"\?\s*$"), 1).when(line.rlike(r"[.!]\s*$"), 2).when(line.rlike(r":\s*$"), 3).otherwise(4)
    return [marker, size, end]


def _featured(lines: DataFrame, *keep: str) -> DataFrame:
    df = lines.select(*keep, F.coalesce(F.col("line"), F.lit("")).alias("line"))
    return df.select("*", *[f.cast("int").alias(f"_f{k}") for k, f in enumerate(features(F.col("line")))])


class Model:
    """Log probabilities: start (STATES), moves (STATES x STATES), and one table a feature (STATES x values)."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: list[np.ndarray]):
        norm = lambda x: np.log((x + 0.1) / (x + 0.1).sum(-1, keepdims=True))
        self.start, self.emits = norm(start), [norm(e) for e in emits]
        allowed = np.zeros((STATES, STATES), bool)
        for s in range(STATES):
            for t in range(STATES):
                same, part, to = s // 3 == t // 3, s % 3, t % 3
                # A turn's lines and gaps keep its role; any role may begin a turn behind any line.
                allowed[s, t] = to == BEGIN or same and (to == GAP or to == INSIDE)
        self.moves = np.where(allowed, norm(moves), -1e9)
        self.start = np.where(np.arange(STATES) % 3 == BEGIN, self.start, -1e9)

    def emission(self, f: np.ndarray) -> np.ndarray:
        return sum(e[:, f[:, k]].T for k, e in enumerate(self.emits))


def fit(labelled: DataFrame) -> Model:
    """From labelled lines: conv_id, turn, at (line of the turn), n (lines of the turn), role, next_role, line."""
    df = _featured(labelled.filter(F.col("role").isin(*ROLES)), "role", "at", "n", "next_role", "turn")
    part = F.when((F.col("at") == F.col("n") - 1) & (F.trim("line") == "") & (F.col("at") > 0), GAP).when(F.col("at") == 0, BEGIN).otherwise(INSIDE)
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1
    next_ = F.array_position(F.array(*map(F.lit, ROLES)), F.col("next_role")) - 1
    df = df.select((role * 3 + part).cast("int").alias("state"), part.alias("part"), "at", "n", "turn", (next_ * 3).cast("int").alias("begins"), *[f"_f{k}" for k in range(len(VALUES))])
    # One small table of counts: by feature and value, of starts, and of moves to a turn's next line or the next turn.
    last = F.col("at") == F.col("n") - 1
    second_last = F.col("at") == F.col("n") - 2
    to = F.when(last, F.col("begins")).when(second_last, F.col("state") - F.col("part") + GAP).otherwise(F.col("state") - F.col("part") + INSIDE)
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(f"_f{k}").alias("value")) for k in range(len(VALUES))]
    kinds += [F.struct(F.lit(10).alias("kind"), to.cast("int").alias("value")), F.struct(F.lit(11).alias("kind"), F.when((F.col("turn") == 0) & (F.col("at") == 0), 0).cast("int").alias("value"))]
    rows = df.select("state", F.explode(F.array(*kinds)).alias("c")).groupBy("state", "c.kind", "c.value").agg(F.count(F.lit(1)).alias("n")).collect()
    emits, start, moves = [np.zeros((STATES, v)) for v in VALUES], np.zeros(STATES), np.zeros((STATES, STATES))
    for r in rows:
        if r["value"] is None:
            continue
        if r["kind"] == 10:
            moves[r["state"], r["value"]] += r["n"]
        elif r["kind"] == 11:
            start[r["state"]] += r["n"]
        else:
            emits[r["kind"]][r["state"], r["value"]] += r["n"]
    return Model(start, moves, emits)


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys in sorted batches."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), bool)
        for k in keys:
            change[1:] |= pdf[k].to_numpy()[1:] != pdf[k].to_numpy()[:-1]
        if rest and any(rest[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys):
            yield pd.concat(rest)
            rest = []
        cuts = [0, *np.flatnonzero(change), len(pdf)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if rest and i:
                yield pd.concat(rest)
                rest = []
            rest.append(pdf.iloc[i:j])
    if rest:
        yield pd.concat(rest)


CHUNK = ["_conv", "_chunk", "_piece"]
FEATURES = [f"_f{k}" for k in range(len(VALUES))]


def _matrices(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, CHUNK):
            best = None
            for e in model.emission(g[FEATURES].to_numpy()):
                # Nothing comes before a transcript's first line; its row is the state of that line itself.
                step = np.where(np.eye(STATES, dtype=bool), e, -1e9) if best is None and g["_first"].iloc[0] else model.moves + e
                best = step if best is None else (best[:, :, None] + step[None]).max(1)
            yield g[CHUNK].iloc[:1].assign(matrix=[best.ravel()])

    return run


def _bounds(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, ["_conv"]):
            matrices = [np.asarray(m).reshape(STATES, STATES) for m in g["matrix"]]
            scores = [model.start]
            for m in matrices:
                scores.append((scores[-1][:, None] + m).max(0))
            ends = [int(scores[-1].argmax())]
            for k in range(len(matrices) - 1, 0, -1):
                ends.append(int((scores[k] + matrices[k][:, ends[-1]]).argmax()))
            ends.reverse()
            yield g[CHUNK].assign(_before=np.array([-1, *ends[:-1]], np.int32), _last=np.array(ends, np.int32))

    return run


def viterbi(model: Model, f: np.ndarray, before: int = -1, last: int = -1) -> np.ndarray:
    """The best states of lines with features f; before: the state ahead of them; last: the one they end in."""
    e = model.emission(f)
    score = model.start + e[0] if before < 0 else model.moves[before] + e[0]
    back = np.zeros((len(f), STATES), np.int8)
    for i in range(1, len(f)):
        step = score[:, None] + model.moves
        back[i] = step.argmax(0)
        score = step.max(0) + e[i]
    out = np.zeros(len(f), np.int64)
    out[-1] = score.argmax() if last < 0 else last
    for i in range(len(f) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def _paths(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for g in _groups(batches, CHUNK):
            state = viterbi(model, g[FEATURES].to_numpy(), int(g["_before"].iloc[0]), int(g["_last"].iloc[0]))
            held.append(g[["conv_id", *CHUNK, "line_no", "at", "line"]].assign(state=state.astype(np.int32), _turn=np.cumsum(state % 3 == BEGIN)))
            if len(held) >= 500:
                yield pd.concat(held)
                held = []
        if held:
            yield pd.concat(held)

    return run


def _chunked(rows: DataFrame, span: int, most: int) -> DataFrame:
    """Adds ``_chunk`` and ``_piece``; chunks in this order hold the lines in theirs."""
    number, at = F.col("line_no"), F.col("at")
    first = number - F.pmod(number, F.lit(span).cast("long"))
    full = stored(rows.groupBy("_conv", first.alias("_block")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select("_conv", "_block", F.lit(True).alias("_full")), "transcript-full")
    rows = rows.withColumn("_block", first).join(full, ["_conv", "_block"], "left")
    chunk = F.when(F.col("_full"), number).otherwise(F.col("_block"))
    piece = F.when(F.col("_full"), at - F.pmod(at, F.lit(most).cast("long"))).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("_chunk", chunk).withColumn("_piece", piece).drop("_block", "_full")


def decode(lines: DataFrame, model: Model, span: int = SPAN, most: int = MOST) -> DataFrame:
    """lines (conv_id, line_no, line, and at, if lines share numbers) with ``state`` and ``turn_no``, the turns numbered from 1 in each transcript."""
    conv = F.xxhash64(F.col("conv_id").isNull(), "conv_id")
    zero = F.lit(0).cast("long")
    at = F.coalesce(F.col("at").cast("long"), zero) if "at" in lines.columns else zero
    rows = lines.select("conv_id", conv.alias("_conv"), F.coalesce(F.col("line_no").cast("long"), zero).alias("line_no"), at.alias("at"), "line")
    rows = _chunked(stored(_featured(rows, "conv_id", "_conv", "line_no", "at"), "transcript-lines"), span, most)
    place = F.struct("_chunk", "_piece")
    many = rows.groupBy("_conv").agg(F.min(place).alias("_lo"), F.max(place).alias("_hi")).filter("_lo < _hi").select("_conv", "_lo")
    order = [*CHUNK, "line_no", "at", "line"]
    long = rows.join(many, "_conv").select(*order, *FEATURES, (place == F.col("_lo")).alias("_first")).repartition(*CHUNK).sortWithinPartitions(*order)
    matrices = stored(long.mapInPandas(_matrices(model), "_conv long, _chunk long, _piece long, matrix array<double>"), "transcript-matrices")
    bounds = matrices.repartition("_conv").sortWithinPartitions(*CHUNK).mapInPandas(_bounds(model), "_conv long, _chunk long, _piece long, _before int, _last int")
    rows = rows.join(bounds, CHUNK, "left").fillna(-1, ["_before", "_last"])
    out = rows.repartition(*CHUNK).sortWithinPartitions(*order).mapInPandas(_paths(model), "conv_id long, _conv long, _chunk long, _piece long, line_no long, at long, line string, state int, _turn long")
    out = stored(out, "transcript-states")
    turns = out.groupBy(*CHUNK).agg(F.max("_turn").alias("_n"))
    turns = turns.select(*CHUNK, (F.sum("_n").over(Window.partitionBy("_conv").orderBy("_chunk", "_piece")) - F.col("_n")).alias("_ahead"))
    out = out.join(turns, CHUNK)
    return out.select("conv_id", "line_no", "at", "line", "state", (F.col("_turn") + F.col("_ahead")).alias("turn_no"))


def turns(decoded: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn_no, role, n_lines, content (without its marker), rendered."""
    text = F.when(F.col("state") % 3 == BEGIN, F.regexp_replace("line", ANY, "")).otherwise(F.col("line"))
    at = F.struct("line_no", "at", "line", text.alias("text"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.floor(F.col("state") / 3) + 1).cast("int"))
    df = decoded.groupBy("conv_id", "turn_no").agg(F.first(role).alias("role"), F.count(F.lit(1)).alias("n_lines"), F.sort_array(F.collect_list(at)).alias("_l"))
    df = df.withColumn("content", F.trim(F.array_join(F.col("_l.text"), "\n"), F.lit(BLANK))).filter("content <> ''")
    return df.select("conv_id", "turn_no", "role", "n_lines", "content", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("\n")).alias("rendered"))


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """Labelled lines of transcripts written from conversations: markers in four styles, one turn in ten without one."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long"))
    style, bare = F.pmod(F.xxhash64("conv_id"), F.lit(4)), F.pmod(F.xxhash64("conv_id", turn), F.lit(10)) == 0
    upper = F.initcap("role")
    short = F.when(F.col("role") == "user", "Q").when(F.col("role") == "assistant", "A").otherwise("System")
    human = F.when(F.col("role") == "user", "Human").when(F.col("role") == "assistant", "AI").otherwise("Instructions")
    mark = F.when(bare, "").when(style == 0, F.concat(upper, F.lit(": "))).when(style == 1, F.concat(F.lit("### "), upper, F.lit("\n"))).when(style == 2, F.concat(short, F.lit(": "))).otherwise(F.concat(human, F.lit(": ")))
    whole = F.concat(F.coalesce(mark, F.lit("")), F.coalesce("text", F.lit("")), F.lit("\n"))
    df = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), "role", F.split(whole, "\n").alias("_l"))
    return df


def lines_of(raw: DataFrame) -> DataFrame:
    df = raw.select("conv_id", "turn", "role", F.size("_l").alias("n"), F.posexplode("_l").alias("at", "line"))
    return df.withColumn("line_no", F.col("turn"))


def with_next(raw: DataFrame) -> DataFrame:
    """Adds the role of the next turn."""
    after = raw.select(F.col("conv_id").alias("_c"), F.try_subtract("turn", F.lit(1).cast("long")).alias("_t"), F.col("role").alias("next_role")).dropDuplicates(["_c", "_t"])
    return raw.join(after, raw["conv_id"].eqNullSafe(F.col("_c")) & (raw["turn"] == F.col("_t")), "left").drop("_c", "_t")


#: Conversations whose id has this remainder by FOLDS are not trained on.
FOLDS, HELD = 5, 0


def parse_conversations(conversations: DataFrame) -> DataFrame:
    """Writes conversations as raw transcripts, fits the model on four folds of five, and parses all of them again."""
    raw = stored(raw_transcripts(conversations), "transcripts")
    train = with_next(raw.filter(F.coalesce(F.pmod(F.col("conv_id"), F.lit(FOLDS)) != HELD, F.lit(True))))
    df = train.select("conv_id", "turn", "role", "next_role", F.size("_l").alias("n"), F.posexplode("_l").alias("at", "line"))
    return turns(decode(lines_of(raw), fit(df)))
