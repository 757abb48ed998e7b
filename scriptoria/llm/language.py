"""Language ID by cross-parsing: how few phrases of a language's labelled text does a text need?

For each language a suffix automaton of a sample of its labelled texts is built. A text is parsed greedily: a phrase is
the longest match with the labelled text from where the last phrase ended. The language that needs fewest phrases wins.
Phrase counts are normalised by what the sample's size lets expect: phrases * log(sample size) / text length.

Texts are read whole, in windows that are parsed side by side; a phrase ends where its window ends, for every language
alike. A null text, or one without a letter, gets ``und`` and score 0. Ties go to the language that sorts first. Equal
rows get equal predictions. With no labelled text at all everything is ``und``. Other columns are ignored, so their
names cannot clash; language, source and id are never inputs of a prediction.
"""

from __future__ import annotations

import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.llm.common import crc32_of, table

UNDETERMINED = "und"


@dataclass(frozen=True)
class ParseRules:
    """The labelled sample of a language has at most sample_rows rows and sample_chars code points; a row is a labelled
    document, or one of its pieces of row_chars code points if it is longer. That of all languages has total_chars, or
    least_chars of each where they are so many. Every labelled language has a model. cells: of the table of common letters'
    moves, at most, of four bytes each; other letters' moves are searched.

    window: code points parsed side by side. sharpness: how fast the score falls with the runner-up's phrases.
    """

    sample_rows: int = 200
    row_chars: int = 2_000
    sample_chars: int = 60_000
    total_chars: int = 400_000
    least_chars: int = 2_000
    cells: int = 40_000_000
    window: int = 1024
    sharpness: float = 20.0


def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def folded(text: str) -> str:
    """Lower case, with everything that is not a letter as one space: digits and symbols say nothing about a language."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Of each state its moves by symbol; 0 is the start, where no move leads."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


@dataclass
class Models:
    """languages; alphabet: the letters that any sample has, the most common first, symbol 1 and up (0: all other characters).

    moves: all automata as one table, a column for each of the common symbols. A state stands as the place of its row in
    the flattened table. Where a state has no move, a phrase ends: the entry is ~ the state that the symbol leads to from
    that automaton's first state. A symbol that its language does not have is a phrase of its own and leads to an
    automaton's last state, which has no moves. starts, ends: each automaton's first and last state. keys, targets: the
    moves by the other symbols, by row * (letters + 1) + symbol, sorted. scale: log of each sample's size.
    """

    languages: list[str]
    alphabet: str
    moves: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    keys: np.ndarray
    targets: np.ndarray
    scale: np.ndarray


def fit(samples: dict[str, str], cells: int = ParseRules.cells) -> Models:
    texts = {k: folded(v) for k, v in sorted(samples.items())}
    texts = {k: v for k, v in texts.items() if v}
    often = Counter()
    for text in texts.values():
        often.update(text)
    alphabet = "".join(sorted(often, key=lambda c: (-often[c], c)))
    number = {c: k + 1 for k, c in enumerate(alphabet)}
    edges, sizes = [], []
    for text in texts.values():
        states = suffix_automaton([number[c] for c in text])
        n = sum(map(len, states))
        edges.append((
            np.repeat(np.arange(len(states)), [len(x) for x in states]),
            np.fromiter((c for x in states for c in x), np.int64, n),
            np.fromiter((t for x in states for t in x.values()), np.int64, n),
        ))
        sizes.append(len(states) + 1)
    # Common symbols, as many as the table has room for; letters that make up less than one in 5,000 of the samples are not.
    total = sum(often.values())
    common = sum(n * 5_000 >= total for n in often.values())
    width = 1 + max(0, min(common, cells // max(sum(sizes), 1) - 1))
    tables, keys, targets, at = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], 0
    for (s, c, t), size in zip(edges, sizes, strict=True):
        place, low = ((t + at) * width).astype(np.int32), c < width
        first = np.full(width, (at + size - 1) * width, np.int32)
        first[c[low & (s == 0)]] = place[low & (s == 0)]
        table = np.repeat(~first[None, :], size, axis=0)
        table[0] = first
        table[s[low], c[low]] = place[low]
        tables.append(table)
        keys.append((s[~low] + at) * (len(alphabet) + 1) + c[~low])
        targets.append(place[~low])
        at += size
    moves = np.concatenate(tables) if tables else np.zeros((0, 1), np.int32)
    after = np.cumsum(np.array(sizes, np.int64))
    starts, ends = ((after - sizes) * width).astype(np.int32), ((after - 1) * width).astype(np.int32)
    keys, targets = np.concatenate(keys), np.concatenate(targets)
    order = np.argsort(keys)
    return Models(list(texts), alphabet, moves, starts, ends, keys[order], targets[order], np.log(np.array([len(t) + 2.0 for t in texts.values()])))


class Parser:
    """Parses batches of texts with all models."""

    def __init__(self, models: Models, rules: ParseRules):
        self.m, self.rules = models, rules
        self.letter = _letters()
        number = np.zeros(sys.maxunicode + 1, np.int32)
        number[[ord(c) for c in models.alphabet]] = np.arange(1, len(models.alphabet) + 1)
        space = number[ord(" ")]
        #: By code point; letters that no sample has are 0.
        lower = np.fromiter((ord(chr(c).lower()[0]) for c in range(sys.maxunicode + 1)), np.int32, sys.maxunicode + 1)
        self.symbol = np.where(self.letter[lower], number[lower], space).astype(np.int32)
        self.flat, self.width = models.moves.ravel(), models.moves.shape[1]

    def rare(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Entries as in the table for symbols that have no column."""
        m, size = self.m, len(self.m.alphabet) + 1

        def move(s: np.ndarray, none: np.ndarray) -> np.ndarray:
            key = s.astype(np.int64) // self.width * size + code[:, None]
            k = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
            return np.where(m.keys[k] == key, m.targets[k], none)

        first = move(np.broadcast_to(m.starts, state.shape), m.ends[None, :])
        return move(state, np.where(state == m.starts, first, ~first))

    def codes(self, text: str) -> tuple[np.ndarray, bool]:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[points]
        out = self.symbol[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one space after a word
        return out[keep], bool(letter.any())

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by text and language, code points parsed, and whether the text has a letter."""
        n, L, w = len(texts), len(self.m.languages), self.rules.window
        parsed = [self.codes(t or "") for t in texts]
        size = np.array([len(c) for c, _ in parsed], np.int64)
        out = np.zeros((n, L), np.int64)
        windows = np.maximum((size + w - 1) // w, 0)
        owner = np.repeat(np.arange(n), windows)
        if L and len(owner):
            first = np.concatenate([np.arange(k) * w for k in windows if k]) if len(owner) else np.zeros(0, np.int64)
            length = np.minimum(w, size[owner] - first)
            joined = np.concatenate([c for c, _ in parsed])
            begin = first + (np.cumsum(size) - size)[owner]
            order = np.argsort(-length, kind="stable")
            begin, length, owner = begin[order], length[order], owner[order]
            found = np.ones((len(owner), L), np.int32)
            state = np.broadcast_to(self.m.starts, (len(owner), L)).copy()
            live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
            for step in range(int(length[0])):
                k = live[step]
                code = joined[begin[:k] + step]
                other = np.flatnonzero(code >= self.width)
                now = self.flat[state[:k] + np.where(code < self.width, code, 0)[:, None]]
                if len(other):
                    now[other] = self.rare(state[other], code[other])
                ends = now >> 31  # -1 where a phrase ends, else 0
                found[:k] -= ends
                state[:k] = now ^ ends
            np.add.at(out, owner, found)
        return out, size, np.array([x for _, x in parsed], bool)


def predict(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, rules: ParseRules = ParseRules()) -> DataFrame:
    """One row per input row: the id, lang_pred and score (0 to 1: how far the winner leads); columns to keep come as keep_0, keep_1 and so on."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kinds, keep = dict(docs.dtypes), keep or []
    schema = f"id {kinds[id_col]}, lang_pred string, score double" + "".join(f", keep_{k} {kinds[c]}" for k, c in enumerate(keep))

    def run(batches):
        parser = Parser(shared.value, rules)
        names = np.array([*shared.value.languages, UNDETERMINED], object)
        for batch in batches:
            at = 0
            texts = batch.column(1).to_pylist()
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to] or "") <= 4_000_000):
                    chars += len(texts[to] or "")
                    to += 1
                phrases, size, letters = parser.phrases(texts[at:to])
                n = to - at
                best, score = np.full(n, len(names) - 1), np.zeros(n)
                if len(names) > 1:
                    cost = phrases * shared.value.scale[None, :] / np.maximum(size, 1)[:, None]
                    weight = np.exp(-rules.sharpness * (cost / cost.min(axis=1, keepdims=True).clip(1e-12) - 1))
                    pick = cost.argmin(axis=1)
                    best = np.where(letters, pick, best)
                    score = np.where(letters, weight[np.arange(n), pick] / weight.sum(axis=1), 0.0)
                made = [batch.column(0).slice(at, n), pa.array(names[best].tolist(), pa.string()), pa.array(score), *(batch.column(2 + k).slice(at, n) for k in range(len(keep)))]
                yield pa.RecordBatch.from_arrays(made, names=["id", "lang_pred", "score", *(f"keep_{k}" for k in range(len(keep)))])
                at = to

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)])
    return given.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def labelled_sample(docs: DataFrame, rules: ParseRules = ParseRules()) -> dict[str, str]:
    """Text per language from training documents (crc32 of the id, mod 3, is not 1), bounded by the rules.

    Rows with the smallest hashes of id and piece are taken, from anywhere in the texts.
    """
    train = docs.where((crc32_of("doc_id") % 3 != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    last = F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / rules.row_chars).cast("int")
    train = train.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("key", F.xxhash64("doc_id", "piece", F.lit(10)))
    ranked = train.select("lang", "key", F.row_number().over(Window.partitionBy("lang").orderBy("key")).alias("rank")).where(F.col("rank") <= rules.sample_rows)
    limits = ranked.groupBy("lang").agg(F.max("key").alias("last"))
    picked = train.join(F.broadcast(limits), "lang").where(F.col("key") <= F.col("last"))
    picked = picked.select("lang", "key", F.substring(F.col("text"), F.col("piece") * rules.row_chars + 1, F.lit(rules.row_chars)).alias("text"))
    most = min(rules.sample_chars, max(rules.least_chars, rules.total_chars // max(limits.count(), 1)))
    before = Window.partitionBy("lang").orderBy("key", "text").rowsBetween(Window.unboundedPreceding, -1)
    picked = picked.withColumn("have", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))).where(F.col("have") < most)
    texts: dict[str, str] = {}
    for r in picked.orderBy("key", "lang", "text").collect():
        texts[r["lang"]] = f"{texts.get(r['lang'], '')} {r['text']}"[:most]
    return texts


def identify(docs: DataFrame, rules: ParseRules = ParseRules()) -> DataFrame:
    """Trains on the labelled part of docs and predicts all of docs."""
    return predict(docs, fit(labelled_sample(docs, rules), rules.cells), rules=rules)


def drop_undetermined(docs: DataFrame, rules: ParseRules = ParseRules()) -> DataFrame:
    """docs without those that have no language to tell: null texts and texts without a letter. A null lang gets the prediction."""
    names = docs.columns
    found = predict(docs, fit(labelled_sample(docs, rules), rules.cells), keep=names, rules=rules).where(F.col("lang_pred") != UNDETERMINED)
    return found.select(*[(F.coalesce(f"keep_{k}", "lang_pred") if c == "lang" else F.col(f"keep_{k}")).alias(c) for k, c in enumerate(names)])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", (crc32_of("doc_id") % 3 == 1).alias("held_out"), "lang_pred", "score")
