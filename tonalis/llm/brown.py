"""Scoring texts with a Brown class-based bigram model.

Words are told apart by a 64-bit number.  Their training counts are one table,
gathered by a shuffle.  The ``HEAD`` most frequent words and ``SHAPES`` shapes of
all others (by their last letters) are the symbols that exchange clustering
assigns to classes: each symbol moves to the class that most raises the mutual
information of successive classes, until none moves.  Then every other training
word is counted with the classes beside it and makes one exchange step, all at
once: from its shape's class to the class that most raises the mutual
information.  A shape's class is left to words that training didn't see.  A
text's probability is the product of class transitions and word emissions, both
smoothed; the share of a word in its class is ``(c + 0.5) / (N + 0.5 * types)``,
unknown words included.

Counts and classes of at most ``TABLE`` frequent words are broadcast; rarer words
meet theirs in a join, gathered for each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, rows, saved
from .langid import held_out

HEAD, SHAPES, CLASSES = 1024, 512, 48
#: Words whose counts are sent to the executors (16 bytes each).
TABLE = 1 << 18
#: Weight of the class frequencies in a transition's probability.
TRANSITION_PRIOR = 10.0
PARTS, PART = 5, 1
END = b""
#: Words that are placed at once, and neighbourhoods that a task remembers.
PLACED, JUDGED = 512, 1 << 17
#: The code of a token whose class is still to be joined.
OPEN = 255
COUNTS = "word long, n long"
BIGRAMS = "pair long, n long"
BESIDE = "word long, old int, seen binary"
CLASSED = "word long, n long, class int"
#: A row for each text, with the class of each token, and one for each rare word of a text, with its places.
CODED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, logs double, codes binary, word long, other int, places binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double"
#: How often a word has a class before it (slots from 0), after it (slots from CLASSES), or itself before it (the last slot).
_SEEN = np.dtype([("slot", "u1"), ("n", "<u4")])


def number(word: bytes) -> int:
    """A word's 64-bit number, signed."""
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def shape(word: bytes) -> int:
    """The shape of a rare word, from its last three bytes."""
    return xxhash.xxh3_64_intdigest(word[-3:]) % SHAPES


def _words(column: pa.Array) -> list[bytes]:
    """The bytes of each string, cut from the array's own buffer."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32, len(column) + 1, column.offset).tolist() if len(column) else [0]
    whole = data.to_pybytes() if data else b""
    return [whole[i:j] for i, j in zip(ends, ends[1:], strict=False)]


class Tokens:
    """The tokens of a batch of texts: distinct words, the word of each token, and where each text begins and ends."""

    def __init__(self, texts: pa.Array) -> None:
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = split.flatten().dictionary_encode()
        words = _words(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if END in words:  # white space at the ends of a text leaves empty words
            real = codes != words.index(END)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            sizes = np.diff(np.concatenate([[0], np.cumsum(real)])[edges])
            codes = codes[real]
        self.words = [*words, END]
        self.numbers = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words)).view(np.int64) ^ np.int64(-(1 << 63))
        self.edges = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.codes = np.full(int(self.edges[-1]), len(words), np.int64)
        at = np.ones(len(self.codes), bool)
        at[self.edges[1:] - 1] = False
        self.codes[at] = codes


@dataclass
class Model:
    """What scoring needs; ``words`` are sorted, ``counts`` and ``classes`` are theirs, ``head`` maps the numbers of head words to symbols, in order of the numbers."""

    head: dict[int, int]
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    classes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    total: int = 0
    types: int = 0
    class_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    log_class: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def symbols(self, tokens: Tokens) -> np.ndarray:
        """The symbol of each distinct word."""
        names, symbols = (np.fromiter(x, np.int64, len(self.head)) for x in (self.head, self.head.values()))
        at = np.minimum(np.searchsorted(names, tokens.numbers), len(names) - 1)
        out = symbols[at]
        for i in np.flatnonzero(names[at] != tokens.numbers).tolist():
            out[i] = HEAD + shape(tokens.words[i])
        return out


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _least_gain(total: float) -> float:
    """What a move has to gain; more than rounding, so that exchange ends."""
    return 1e-9 + 1e-12 * float(_f(np.float64(total)))


def exchange(bigrams: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each symbol, by exchange clustering of a symbol x symbol matrix of successions, until no symbol moves."""
    n = bigrams.astype(np.float64)
    left, right = n.sum(axis=1), n.sum(axis=0)
    order = np.argsort(-(left + right), kind="stable")
    of = np.empty(len(n), np.int64)
    of[order] = np.arange(len(n)) % classes
    member = np.zeros((len(n), classes))
    member[np.arange(len(n)), of] = 1
    outs, ins = n @ member, n.T @ member
    table = member.T @ outs
    lefts, rights = member.T @ left, member.T @ right
    f, enough = _f, _least_gain(n.sum())
    diagonal = np.arange(classes)
    moved = 1
    while moved:
        moved = 0
        for w in order.tolist():
            if not left[w] + right[w]:
                continue
            old, own = int(of[w]), n[w, w]
            out, into = outs[w].copy(), ins[w].copy()
            out[old] -= own
            into[old] -= own
            table[old] -= out
            table[:, old] -= into
            table[old, old] -= own
            lefts[old] -= left[w]
            rights[old] -= right[w]
            base = f(table)
            gain = (f(table + out) - base).sum(axis=1) + (f(table + into[:, None]) - base).sum(axis=0)
            d = table[diagonal, diagonal]
            gain += f(d + out + into + own) - f(d + out) - f(d + into) + f(d)
            gain -= f(lefts + left[w]) - f(lefts) + f(rights + right[w]) - f(rights)
            new = int(gain.argmax())
            if gain[new] <= gain[old] + enough:
                new = old
            table[new] += out
            table[:, new] += into
            table[new, new] += own
            lefts[new] += left[w]
            rights[new] += right[w]
            if new != old:
                moved += 1
                of[w] = new
                outs[:, old] -= n[:, w]
                outs[:, new] += n[:, w]
                ins[:, old] -= n[w]
                ins[:, new] += n[w]
    return of


#: Counts up to which a step's gain is looked up.
SMALL = 16


class Gains:
    """What counts from 1 to ``SMALL`` add to ``x log x`` of every cell of ``cells``; number ``n`` is at ``n``."""

    def __init__(self, cells: np.ndarray) -> None:
        n = np.arange(SMALL + 1).reshape(-1, *[1] * cells.ndim)
        self.of = _f(cells + n) - _f(cells)


class Placing:
    """``placed`` for one table of successions."""

    def __init__(self, table: np.ndarray) -> None:
        self.table, self.sides = table, (table.T, table)
        self.cells = [Gains(x).of for x in self.sides]
        self.totals = [(x, Gains(x).of) for x in (table.sum(axis=1), table.sum(axis=0))]
        self.enough = _least_gain(table.sum())

    def _beside(self, old: np.ndarray, beside: np.ndarray, across: np.ndarray, own: np.ndarray, side: int) -> np.ndarray:
        """The gain from the cells of successions of each class and the word, the word itself taken out of its old class."""
        successions, known = self.sides[side], self.cells[side]
        gain = np.zeros(beside.shape)
        word, cls = np.nonzero(beside)
        n = beside[word, cls]
        quick = (n <= SMALL) & (cls != old[word])
        for k in np.unique(n[quick]).astype(np.int64).tolist():
            gain += (beside == k) @ known[k]
        # looked up as well, but not to be: the own class' row, and every row's cell of the old class
        wrong = np.flatnonzero((n <= SMALL) & ~quick)
        np.subtract.at(gain, word[wrong], known[n[wrong].astype(np.int64), cls[wrong]])
        at = np.flatnonzero(quick)
        w, m = word[at], n[at]
        cell = successions[cls[at], old[w]]
        gain[np.arange(len(old)), old] += np.bincount(w, 2 * _f(cell) - _f(cell - m) - _f(cell + m), len(old))
        at = np.flatnonzero(~quick)
        if len(at):
            w, c, m = word[at], cls[at], n[at]
            cells = successions[c]
            cells[np.arange(len(w)), old[w]] -= m
            same = np.flatnonzero(c == old[w])
            cells[same] -= across[w[same]]
            cells[same, old[w[same]]] -= own[w[same]]
            some, first = np.unique(w, return_index=True)
            gain[some] += np.add.reduceat(_f(cells + m[:, None]) - _f(cells), first, axis=0)
        return gain

    def placed(self, old: np.ndarray, into: np.ndarray, out: np.ndarray, own: np.ndarray) -> np.ndarray:
        """See ``placed``."""
        row = np.arange(len(old))
        gain = self._beside(old, out, into, own, 0) + self._beside(old, into, out, own, 1)
        # a class beside itself: the cells above count what comes before and after apart
        w, c = np.nonzero(((out > 0) & (into > 0)) | (own > 0)[:, None])
        d = self.table[c, c] - np.where(c == old[w], out[w, c] + into[w, c] + own[w], 0)
        x, y = out[w, c], into[w, c]
        gain[w, c] += _f(d + x + y + own[w]) - _f(d + x) - _f(d + y) + _f(d)
        for (total, known), n in zip(self.totals, (out.sum(axis=1) + own, into.sum(axis=1) + own), strict=True):
            few = n <= SMALL
            gain[few] -= known[n[few].astype(np.int64)]
            many = np.flatnonzero(~few)
            gain[many] -= _f(total + n[many, None]) - _f(total)
            rest = total[old] - n
            gain[row, old] -= _f(rest + n) - _f(rest) - _f(total[old] + n) + _f(total[old])
        new = gain.argmax(axis=1)
        return np.where(gain[row, new] > gain[row, old] + self.enough, new, old)


def placed(table: np.ndarray, old: np.ndarray, into: np.ndarray, out: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The best class of each word (row), each moved alone, by the gain that ``exchange`` has.

    ``table`` are the successions of classes with every word in its ``old`` class;
    ``into`` and ``out`` count the classes before and after each word (word x
    class, some in each row), ``own`` its successions to itself.
    """
    return Placing(table).placed(old, into, out, own)


def _texts(df: DataFrame) -> DataFrame:
    learns = F.col("doc_id").isNotNull() & ~held_out("doc_id", PARTS, PART)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out("doc_id", PARTS, PART).alias("held_out"), learns.alias("learns"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = Tokens(batch["text"])
        n = np.bincount(tokens.codes, minlength=len(tokens.words))
        at = np.flatnonzero(n)
        if len(at):
            yield rows(COUNTS, word=tokens.numbers[at], n=n[at])


def _beside(tokens: Tokens, symbols: np.ndarray, of: np.ndarray) -> pa.RecordBatch | None:
    """What stands beside each word that is no head word."""
    codes, cls = tokens.codes, of[symbols][tokens.codes]
    end = len(tokens.words) - 1
    at = np.flatnonzero(symbols[codes] >= HEAD)
    if not len(at):
        return None
    first = np.zeros(len(codes), bool)
    first[tokens.edges[:-1][tokens.edges[:-1] < len(codes)]] = True
    before = np.where(first[at], end, codes[at - 1])
    after = codes[at + 1]  # a text's last token is the end
    twin, next_twin = before == codes[at], after == codes[at]
    slots = 2 * CLASSES + 1
    key = np.concatenate([codes[at] * slots + np.where(twin, slots - 1, of[symbols][before]), (codes[at] * slots + CLASSES + cls[at + 1])[~next_twin]])
    key, n = np.unique(key, return_counts=True)
    seen = np.empty(len(key), _SEEN)
    seen["slot"], seen["n"] = key % slots, n
    word, start = np.unique(key // slots, return_index=True)
    data, cut = seen.tobytes(), (np.append(start, len(key)) * _SEEN.itemsize).tolist()
    return rows(BESIDE, word=tokens.numbers[word], old=of[symbols[word]].astype(np.int32), seen=[data[i:j] for i, j in zip(cut, cut[1:], strict=False)])


def _place(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The class and count of each word from its ``BESIDE`` rows, which come together.

    Words of one old class that stand beside the same classes equally often, as
    most of those seen once do, are judged once.
    """
    held: list[tuple[np.ndarray, np.ndarray, list[bytes]]] = []
    judged: dict[bytes, tuple[int, int]] = {}
    slots, placing = 2 * CLASSES + 1, Placing(table)

    def judge(beside: list[bytes]) -> None:
        old = np.array([x[0] for x in beside], np.int64)
        data = np.frombuffer(b"".join(x[1:] for x in beside), _SEEN)
        owner = np.repeat(np.arange(len(beside)), [len(x) // _SEEN.itemsize for x in beside])
        n = np.bincount(owner * slots + data["slot"], data["n"], len(beside) * slots).reshape(-1, slots)
        into, out, own = n[:, :CLASSES], n[:, CLASSES:-1], n[:, -1]
        new = placing.placed(old, into, out, own)
        judged.update(zip(beside, zip(new.tolist(), (into.sum(axis=1) + own).astype(np.int64).tolist(), strict=True), strict=True))

    def done(last: bool) -> Iterator[pa.RecordBatch]:
        word, old = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        seen = [x for h in held for x in h[2]]
        end = len(word) if last or not len(word) else int(np.flatnonzero(word != word[-1])[-1] + 1) if (word != word[-1]).any() else 0
        held[:] = [] if last else [(word[end:], old[end:], seen[end:])]
        starts = np.flatnonzero(np.append(True, word[1:end] != word[: end - 1])) if end else np.zeros(0, np.int64)
        if len(judged) > JUDGED:
            judged.clear()
        cut = [*starts.tolist(), end]
        beside = [bytes([o]) + (seen[i] if j == i + 1 else b"".join(sorted(seen[i:j]))) for o, i, j in zip(old[starts].tolist(), cut, cut[1:], strict=False)]
        fresh = [x for x in dict.fromkeys(beside) if x not in judged]
        for i in range(0, len(fresh), PLACED):
            judge(fresh[i : i + PLACED])
        if beside:
            cls, n = zip(*map(judged.__getitem__, beside), strict=True)
            yield rows(CLASSED, word=word[starts], n=n, **{"class": cls})

    for batch in batches:
        held.append((batch["word"].to_numpy(), batch["old"].to_numpy(), batch["seen"].to_pylist()))
        yield from done(False)
    if held:
        yield from done(True)


def _classes_of(codes: pa.Array, gathered: pa.Array) -> Iterator[np.ndarray]:
    """The class of each token of each text, those of its rare words (``class``, ``places``) filled in."""
    for data, more in zip(codes.to_pylist(), gathered.to_pylist(), strict=True):
        of = np.frombuffer(data, np.uint8)
        if more:
            of = of.copy()
            at = np.frombuffer(b"".join(m["places"] for m in more), "<i4")
            of[at] = np.repeat([m["class"] for m in more], [len(m["places"]) // 4 for m in more])
        yield of.astype(np.int64)


def _transitions(texts: DataFrame) -> DataFrame:
    """Successions of classes (``pair``, ``n``) in coded texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for of in _classes_of(batch["codes"], batch["gathered"]):
                # a text begins after the end of another
                table += np.bincount(np.append(of[-1], of[:-1]) * CLASSES + of, minlength=CLASSES * CLASSES)
        yield rows(BIGRAMS, pair=np.arange(len(table)), n=table)

    return map_batches(texts.select("codes", "gathered"), work, BIGRAMS).groupBy("pair").agg(F.sum("n").alias("n"))


def learn(df: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the table of all training words' counts and classes (``word``, ``n``, ``class``), written to the shared folder.

    Learned from the rows (``doc_id``, ``text``) that aren't held out; those
    without a ``doc_id`` teach nothing, null and empty texts only the end token,
    and repeated rows count as often as they occur.  An empty table gives a model
    without words, by which all texts score alike but for their length.
    """
    model, classed, _ = _learn(df)
    return model, classed


def learn_and_score(df: DataFrame) -> DataFrame:
    """``score`` of ``df`` by the model that ``learn`` makes of it; its texts are coded once for both."""
    model, _, coded = _learn(df)
    return _scored(coded, model)


def _learn(df: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """Model and classes as ``learn`` gives them, and the coded texts of the whole table."""
    spark = df.sparkSession
    every = _texts(df)
    texts = every.where("learns")
    counts = saved(map_batches(texts, _count, COUNTS).groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    end = number(END)
    sums = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == end, F.col("n")))).first()
    top = [(end, sums[2] or 0), *map(tuple, counts.where(F.col("word") != end).orderBy(F.desc("n"), "word").limit(HEAD - 1).collect())]
    model = Model(dict(sorted((w, i) for i, (w, _) in enumerate(top))), total=sums[0] or 0, types=sums[1])
    sent = spark.sparkContext.broadcast(model)
    size = HEAD + SHAPES

    def successions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int64)
        for batch in batches:
            tokens = Tokens(batch["text"])
            now = sent.value.symbols(tokens)[tokens.codes]
            before = np.concatenate([[0], now[:-1]])
            before[tokens.edges[:-1][tokens.edges[:-1] < len(before)]] = 0
            table += np.bincount(before * size + now, minlength=size * size)
        at = np.flatnonzero(table)
        for i in range(0, len(at), 100_000):
            yield rows(BIGRAMS, pair=at[i : i + 100_000], n=table[at[i : i + 100_000]])

    pairs = map_batches(texts, successions, BIGRAMS).groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    bigrams = np.zeros(size * size)
    bigrams[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    of = model.class_of = exchange(bigrams.reshape(size, size))
    member = np.zeros((size, CLASSES))
    member[np.arange(size), of] = 1
    first = member.T @ bigrams.reshape(size, size) @ member

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = Tokens(batch["text"])
            if (found := _beside(tokens, sent.value.symbols(tokens), of)) is not None:
                yield found

    met = map_batches(texts, beside, BESIDE).repartition("word").sortWithinPartitions("word")
    heads = spark.createDataFrame([(w, n, int(of[i])) for i, (w, n) in enumerate(top) if n], CLASSED)
    classed = saved(map_batches(met, lambda batches: _place(batches, first), CLASSED).unionByName(heads), "word-classes")
    level = F.floor(F.log2("n") * 16).cast("int")
    held, least = 0, None
    for at, t in sorted((tuple(r) for r in classed.groupBy(level.alias("level")).agg(F.count("*").alias("types")).collect()), reverse=True):  # the highest levels that fit the table
        if held + t > TABLE:
            break
        held, least = held + t, at
    if least is not None:
        frequent = classed.where(level >= least).toArrow()
        order = np.argsort(frequent["word"].to_numpy())
        model.words, model.counts = (frequent[c].to_numpy()[order] for c in ("word", "n"))
        model.classes = frequent["class"].to_numpy()[order].astype(np.uint8)
    coded = _coded(every, model, classed)
    pairs = _transitions(coded.where("doc_id IS NOT NULL AND NOT held_out")).toArrow()
    table = np.zeros(CLASSES * CLASSES)
    table[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    table = table.reshape(CLASSES, CLASSES)
    prior = (table.sum(axis=0) + 1) / (table.sum() + CLASSES)
    model.transition = np.log10((table + TRANSITION_PRIOR * prior) / (table.sum(axis=1, keepdims=True) + TRANSITION_PRIOR))
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classed.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        mass[r["class"]], kinds[r["class"]] = r["n"], r["types"]
    rare = np.zeros(CLASSES)
    rare[of[HEAD:]] = 1  # a class of shapes also holds words yet unseen
    model.log_class = np.log10(np.maximum(mass + 0.5 * (kinds + rare), 0.5))
    return model, classed, coded


def _coded(texts: DataFrame, model: Model, classed: DataFrame) -> DataFrame:
    """Each text with its unigram score, the logarithms of its words' counts, its known words, and its tokens' classes.

    ``codes`` holds a byte for each token; the classes of rare words are
    ``gathered`` beside it and their counts added.
    """
    sent = texts.sparkSession.sparkContext.broadcast(model)
    log_all = float(np.log10(model.total + 0.5 * (model.types + 1)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            tokens = Tokens(batch["text"])
            size = len(tokens.edges) - 1
            if not size:
                continue
            at = np.minimum(np.searchsorted(m.words, tokens.numbers), max(0, len(m.words) - 1))
            common = m.words[at] == tokens.numbers if len(m.words) else np.zeros(len(tokens.words), bool)
            logs = np.where(common, np.log10((m.counts[at] if len(m.words) else 0) + 0.5), 0.0)[tokens.codes]
            codes = np.where(common, m.classes[at] if len(m.words) else 0, OPEN).astype(np.uint8)[tokens.codes].tobytes()
            other = m.class_of[m.symbols(tokens)].astype(np.int32)
            begin, edges = tokens.edges[:-1], tokens.edges.tolist()
            known = np.add.reduceat(common[tokens.codes].astype(np.int64), begin)
            own = row + np.arange(size)
            row += size
            none = [None] * size
            yield rows(CODED, row=own, doc_id=batch["doc_id"], held_out=batch["held_out"], n_tokens=np.diff(tokens.edges), n_known=known, base=np.add.reduceat(logs - log_all, begin), logs=np.add.reduceat(logs, begin), codes=[codes[i:j] for i, j in zip(edges, edges[1:], strict=False)], word=none, other=none, places=none)
            text = np.repeat(np.arange(size), np.diff(tokens.edges))
            rare = np.flatnonzero(~common[tokens.codes])
            pair = text[rare] * len(tokens.words) + tokens.codes[rare]
            order = np.argsort(pair, kind="stable")
            pair, first = np.unique(pair[order], return_index=True)
            places = (rare - begin[text[rare]])[order].astype("<i4").tobytes()
            cut = (np.append(first, len(rare)) * 4).tolist()
            for i in range(0, len(pair), 50_000):
                mine = pair[i : i + 50_000]
                k, name = len(mine), mine % len(tokens.words)
                none = [None] * k
                yield rows(CODED, row=own[mine // len(tokens.words)], doc_id=none, held_out=none, n_tokens=none, n_known=none, base=none, logs=none, codes=none, word=tokens.numbers[name], other=other[name], places=[places[a:b] for a, b in zip(cut[i : i + k], cut[i + 1 : i + k + 1], strict=True)])

    found = saved(map_batches(texts, work, CODED), "coded")
    rare = found.where("word IS NOT NULL").select("row", "word", "other", "places").join(classed.select("word", F.col("n").alias("c"), "class"), "word", "left")
    n = F.length("places") / 4
    share = n * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    tail = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, n).otherwise(0)).cast("long").alias("more"), F.sum(share).alias("extra"), F.collect_list(F.struct(F.coalesce("class", "other").alias("class"), "places")).alias("gathered"))
    extra = F.coalesce("extra", F.lit(0.0))
    both = found.where("word IS NULL").join(tail, "row", "left")
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("base") + extra).alias("base"), (F.col("logs") + extra).alias("logs"), "codes", "gathered")


def score(df: DataFrame, model: Model, classed: DataFrame) -> DataFrame:
    """Scores the whole ``text`` of every row; null texts count as empty, that is one end token.

    Further columns are ignored, repeated rows are scored alike, and a null
    ``doc_id`` is carried, counts as not held out and is not learned from.
    ``base_score`` is the unigram's log10 probability of the text, ``score`` the
    class model's, ``perplexity`` that of the class model for each token.  An
    empty table gives no rows.
    """
    return _scored(_coded(_texts(df), model, classed), model)


def _scored(coded: DataFrame, model: Model) -> DataFrame:
    sent = coded.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        start = int(m.class_of[m.head[number(END)]])
        for batch in batches:
            ours = np.array([(m.transition[np.append(start, of[:-1]), of] - m.log_class[of]).sum() for of in _classes_of(batch["codes"], batch["gathered"])])
            yield rows(SCORED, **{c: batch[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "base")}, model=ours + batch["logs"].to_numpy())

    found = map_batches(coded, work, SCORED)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"), F.pow(F.lit(10.0), -F.col("model") / F.col("n_tokens")).alias("perplexity"))
