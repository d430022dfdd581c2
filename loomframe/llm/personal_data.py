"""Personal data: base patterns, and candidates judged by gradient boosted trees.

Generators of high recall propose overlapping spans, also of numbers and addresses written to evade patterns ("[at]",
"(dot)", unusual separators). Trees over format and context features, boosted on the logistic loss, give each a
probability; per kind, a threshold calibrated on documents the trees have not seen decides.

The trees learn from matches of the base patterns that are rewritten in place, with the text around them as it is: in
evasive forms of the same content (positive), and in forms of which the content no longer holds (a wrong check digit, an
octet above 255, too few digits; negative). Whatever else the generators propose in these documents, such as other long
numbers, is negative too. Spans of the base patterns always stay.
"""

from __future__ import annotations

import contextlib
import random
import re
import zlib
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .fitting import sigmoid
from .found import Span, scan
from .stash import stash

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: Generators of high recall. E-mail addresses are looked for around each sign, so that long words without one cost nothing.
SIGN = re.compile(r"@|\x20?[\[({<][Aa][Tt][\])}>]\x20?|\x20at\x20")
LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\x20?[\[({<](?:[Dd][Oo][Tt]|\.)[\])}>]\x20?|\x20dot\x20)[A-Za-z0-9-]+)+")
LOOSE = {
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,4}(?:(?:\.|\x20?[\[({](?:\.|dot)[\])}]\x20?|\x20\.\x20|\x20dot\x20)[0-9]{1,4}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9](?:\x20?[-._/]?\x20?[0-9]){12,18}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z.+])(?:\+|00|\()?[0-9][\x20()./0-9-]{7,22}[0-9](?![0-9A-Za-z])"),
}
CONTEXT = {
    "email": re.compile("mail|contact|@|write to|kontakt|correo", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|adresse", re.I),
    "card": re.compile("card|visa|credit|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile("phone|tel|call|mobile|fax|handy|llam", re.I),
}
FEATURES = (
    "length", "digits", "groups", "longest_group", "spaces", "dashes", "dots", "slashes", "brackets", "separators", "holds",
    "prefix", "context", "glued_before", "glued_after", "line_start", "line_end", "other_numbers",
)
#: Ways to write a sign, a dot or a gap between digits that the base patterns do not read.
AT = (" [at] ", "(at)", "[at]", " at ", " (AT) ")
DOT = ("[dot]", " (dot) ", " dot ", "(DOT)")
IP_DOT = ("[.]", " . ", "(.)", " dot ", "[dot]")
GAP = (".", "/", " - ", "_")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """As the pattern [A-Za-z0-9._%+-]+@domain finds them, without a try at every letter of every word."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end(), "email"
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap within the kind; matches that fail their test are dropped."""
    out = list(_emails(text)) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [x.lstrip("0") or "0" for x in m.group().split(".")]
            if all(len(x) <= 3 and int(x) <= 255 for x in parts):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = re.sub("[^0-9]", "", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return out


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of every kind."""
    out = []
    for sign in SIGN.finditer(text):
        start = sign.start()
        while start and text[start - 1] in LOCAL:
            start -= 1
        found = LOOSE_DOMAIN.match(text, sign.end()) if start < sign.start() else None
        # a bare word "at" is a sign only if the dots are written out as well
        if found and (sign.group() != " at " or not re.fullmatch(r"[A-Za-z0-9.-]+", found.group())):
            out.append((start, found.end(), "email"))
    if DIGIT.search(text):
        for kind, pattern in LOOSE.items():
            out += [(*m.span(), kind) for m in pattern.finditer(text)]
    return sorted(set(out))


def holds(word: str, kind: str) -> bool:
    """Whether the content passes the kind's test, however it is written."""
    numbers = re.findall("[0-9]+", word)
    digits = "".join(numbers)
    if kind == "ip":
        return len(numbers) == 4 and all(int(x) <= 255 for x in numbers)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    last = re.split(r"[^A-Za-z0-9-]+", word.rstrip(")]}>"))[-1]
    return len(last) >= 2 and last.isalpha()


def coarse(n: int) -> int:
    """Numbers from 32 on keep their five leading bits: a description takes few different values, however long the match."""
    low = max(0, n.bit_length() - 5)
    return n >> low << low


def describe(text: str, span: Span) -> list[float]:
    a, b, kind = span
    word, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 20]
    groups = re.findall("[0-9]+", word)
    brackets = sum(map(word.count, "([{<"))
    return [
        *map(coarse, (b - a, sum(map(len, groups)), len(groups), max(map(len, groups), default=0), word.count(" "), word.count("-"))),
        *map(coarse, (word.count("."), word.count("/") + word.count("_"), brackets, len(set(re.findall(r"[^0-9A-Za-z]+", word))))),
        float(holds(word, kind)), float(word.startswith(("+", "00", "("))), float(bool(CONTEXT[kind].search(before))),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in ("", "\n")),
        float(after[:1] in ("", "\n")), coarse(len(re.findall("[0-9]+", before + after))),
    ]


def rewritten(word: str, kind: str, draw: random.Random) -> tuple[str, str]:
    """A base match in an evasive form, and in one whose content does not hold."""
    numbers = re.findall("[0-9]+", word)
    digits = "".join(numbers)

    def grouped(d: str, size: int) -> str:
        return draw.choice(GAP).join(d[i : i + size] for i in range(0, len(d), size))

    if kind == "email":
        local, domain = word.split("@", 1)
        dot = draw.choice(DOT)
        parts = domain.split(".")
        return local + draw.choice(AT) + dot.join(parts), local + draw.choice(AT) + dot.join([*parts[:-1], draw.choice("0123456789")])
    if kind == "ip":
        dot = draw.choice(IP_DOT)
        wrong = [*numbers]
        wrong[draw.randrange(4)] = str(draw.randrange(256, 2000))
        return dot.join(numbers), dot.join(wrong)
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + draw.randrange(1, 10)) % 10)
        return grouped(digits, 4), draw.choice((wrong, grouped(wrong, 4)))
    short = digits[: draw.randrange(8, 10)]
    plain = draw.choice((f"00{digits[:11]}" if len(digits) < 12 else digits, f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", grouped(digits[-10:], 3)))
    return plain, draw.choice((short, grouped(short, 4).replace("_", " ")))


def lessons(text: str) -> list[tuple[str, list[float], bool, int]]:
    """(kind, description, whether it is personal data, a hash of the surroundings) of what the generators propose in a text
    and in its rewritten matches."""

    def lesson(near: str, s: Span, label: bool) -> tuple[str, list[float], bool, int]:
        return s[2], describe(near, s), label, zlib.crc32(near[max(0, s[0] - 40) : s[1] + 40].encode("utf-8", "replace"))

    base = base_spans(text)
    out = [lesson(text, s, False) for s in candidates(text) if not any(s[0] < e and a < s[1] for a, e, _ in base)]
    draw = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    for a, b, kind in base:
        for _ in range(2):
            for word, label in zip(rewritten(text[a:b], kind, draw), (True, False), strict=True):
                around = text[max(0, a - 60) : a], text[b : b + 60]
                near = around[0] + word + around[1]
                start = len(around[0])
                for s in candidates(near):
                    if s[2] == kind and s[0] < start + len(word) and start < s[1]:
                        out.append(lesson(near, s, label and s[0] <= start and s[1] >= start + len(word)))
    return out


#: A gradient is added up as a whole number of this part of one, so sums do not depend on the order of the rows.
UNIT = 2.0**-34
#: Steps of the probabilities that a threshold may take.
STEPS = 10_000


class BoostedTrees:
    """Trees of depth 2, boosted on the logistic loss; each leaf takes one Newton step.

    They grow from sums over the rows, wherever these are (see ``grown``); rows given here are summed in place.
    """

    def __init__(self, x: np.ndarray | None = None, y: np.ndarray | None = None, rounds: int = 60, rate: float = 0.2, bins: int = 24, least: int = 10):
        self.start, self.trees = 0.0, []
        if y is None or not len(y):
            return
        self.start = odds(int(len(y) - y.sum()), int(y.sum()))
        if y.min() == y.max():
            return
        cuts = [edges_of(*np.unique(x[:, j], return_counts=True), bins) for j in range(x.shape[1])]
        growing, weight, sums = grown(self, cuts, rounds, rate, least), np.ones(len(y), np.int64), None
        with contextlib.suppress(StopIteration):
            while True:
                root = growing.send(sums)
                sums = histograms(self, cuts, root, x, y, weight)

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for j, t, left, right in self.trees:
            a, b = (np.where(x[:, k] <= u, lo, hi) for k, u, lo, hi in (left, right))
            z += np.where(x[:, j] <= t, a, b)
        return z

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x))


def odds(no: int, yes: int) -> float:
    """The logarithm of the odds, bounded; 0 without rows."""
    share = np.clip(yes / (no + yes), 1e-3, 1 - 1e-3) if no + yes else 0.5
    return float(np.log(share / (1 - share)))


def edges_of(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Quantiles between the bins of ascending values that occur so often."""
    values, upto = np.asarray(values, float), np.cumsum(counts)
    place = np.linspace(0, 1, bins + 1)[1:-1] * (upto[-1] - 1)
    low, high = (values[np.searchsorted(upto, np.clip(i, 0, upto[-1] - 1), "right")] for i in (np.floor(place), np.floor(place) + 1))
    return np.unique(low + (place - np.floor(place)) * (high - low))


def histograms(trees: BoostedTrees, cuts: list[np.ndarray], root: tuple | None, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of gradients, curvatures and numbers of lessons: (side of the root, feature, bin, 3), in whole units."""
    width = max(map(len, cuts)) + 1
    p = trees.probability(x)
    parts = [np.round(v / UNIT).astype(np.int64) * weight for v in (y - p, p * (1 - p))] + [weight]
    side = np.zeros(len(x), np.int64) if root is None else (x[:, root[0]] > root[1]).astype(np.int64)
    out = np.zeros((2, len(cuts), width, 3), np.int64)
    for j, edges in enumerate(cuts):
        slot = np.searchsorted(edges, x[:, j], "left")
        for i, v in enumerate(parts):
            np.add.at(out[:, j, :, i], (side, slot), v)
    return out


def split(sums: np.ndarray, cuts: list[np.ndarray], least: int, turn: int) -> tuple | None:
    """(feature, edge) of the largest gain over one node's sums, or None; features that are equally good take turns."""
    top = None
    for j in (*range(turn % len(cuts), len(cuts)), *range(turn % len(cuts))):
        edges = cuts[j]
        g, h, n = (sums[j, : len(edges) + 1, i].cumsum() * (UNIT if i < 2 else 1) for i in range(3))
        G, H, N = g[-1], h[-1], n[-1]
        g, h, n = g[:-1], h[:-1], n[:-1]
        gain = g**2 / (h + 1) + (G - g) ** 2 / (H - h + 1) - G**2 / (H + 1)
        gain[(n < least) | (N - n < least)] = 0
        if len(gain) and gain.max() > (top[0] * (1 + 1e-6) if top else 1e-6):
            top = (gain.max(), j, edges[int(gain.argmax())])
    return top and top[1:]


def grown(trees: BoostedTrees, cuts: list[np.ndarray], rounds: int = 60, rate: float = 0.2, least: int = 10) -> Generator[tuple | None, np.ndarray, None]:
    """Grow trees: yields the root by whose sides it wants sums, or None, and is sent the ``histograms`` of all rows."""
    for turn in range(rounds):
        root = split((yield None)[0], cuts, least, turn)
        if not root:
            return
        sides = []
        for sums in (yield root):
            k, u = split(sums, cuts, least, turn) or (0, np.inf)
            at = int(np.searchsorted(cuts[k], u, "right")) if u < np.inf else sums.shape[1]
            sides.append((k, u, *(float(rate * s[0] * UNIT / (s[1] * UNIT + 1)) for s in (sums[k, :at].sum(0), sums[k, at:].sum(0)))))
        trees.trees.append((*root, *sides))


class Judge:
    """Trees and a calibrated threshold for each kind.

    ``report``: by kind, the threshold's precision and recall on the documents that the trees have not seen, and the number
    of positives among them. The threshold is the lowest step with at least ``precision`` over at least ``least``
    candidates; a kind without one adds nothing.
    """

    def __init__(self, trees: dict[str, BoostedTrees], held: dict[str, np.ndarray], precision: float, least: int = 20):
        """``held``: by kind, the numbers of other candidates and of positives at each step of the probability."""
        self.trees, self.thresholds, self.report = trees, {}, {}
        for kind in KINDS:
            right = held[kind][:, 1][::-1].cumsum()[::-1]
            taken = held[kind].sum(1)[::-1].cumsum()[::-1]
            good = np.flatnonzero((held[kind].sum(1) > 0) & (right >= precision * taken) & (taken >= least))
            self.thresholds[kind] = int(good[0]) if len(good) else STEPS + 1
            if len(good):
                at = good[0]
                self.report[kind] = (float(right[at] / taken[at]), float(right[at] / right[0]), int(right[0]))

    def accept(self, spans: list[Span], x: np.ndarray) -> list[Span]:
        """The spans at or above their kind's threshold; of overlapping ones the likeliest."""
        kinds, p, over = np.array([s[2] for s in spans]), np.zeros(len(spans)), np.zeros(len(spans), bool)
        for kind in KINDS:
            own = np.flatnonzero(kinds == kind)
            if len(own):
                p[own] = self.trees[kind].probability(x[own])
                over[own] = np.floor(p[own] * STEPS) >= self.thresholds[kind]
        out: list[Span] = []
        for i in np.lexsort((np.arange(len(spans)), -p)):
            if over[i] and not any(spans[i][0] < e and a < spans[i][1] for a, e, _ in out):
                out.append(spans[i])
        return sorted(out)


def fit_judge(docs: DataFrame, text: str = "text", precision: float = 0.9, bins: int = 24) -> Judge:
    """Fit on the lessons of all documents; neither texts nor lessons leave the executors.

    A line may be copied into many documents: what stands in the same surroundings counts once. Equal lessons are one row
    with a weight, written once; each step of the boosting sums gradients over these rows, and what comes to the driver are
    sums by feature and bin, numbers of each value of a feature, and numbers by steps of the probability.
    """
    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.list_(pa.float64()), pa.bool_(), pa.int64(), pa.bool_())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # few texts at a time as Python strings
                rows = []
                for t in batch.column(0).slice(at, 256).to_pylist():
                    held = zlib.crc32((t or "").encode("utf-8", "replace")) % 2 == 1
                    rows += [(*lesson, held) for lesson in lessons(t or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["kind", "x", "y", "near", "held"])

    once = docs.select(F.col(text).alias("text")).where("text is not null").mapInArrow(learnt, "kind string, x array<double>, y boolean, near long, held boolean").distinct()
    table = stash(once.groupBy("kind", "x", "y", "held").agg(F.count(F.lit(1)).alias("n")), "lessons")

    taught = table.where("not held")
    values = taught.select("kind", "n", F.posexplode("x").alias("j", "v")).groupBy("kind", "j", "v").agg(F.sum("n").alias("n"))
    of = {kind: [([], []) for _ in FEATURES] for kind in KINDS}
    for r in values.orderBy("v").collect():  # descriptions are coarse, so a feature has few values, however many lessons
        for side, v in zip(of[r["kind"]][r["j"]], (r["v"], r["n"]), strict=True):
            side.append(v)
    number = {kind: {False: 0, True: 0} for kind in KINDS}
    for r in taught.groupBy("kind", "y").agg(F.sum("n").alias("n")).collect():
        number[r["kind"]][r["y"]] = r["n"]
    trees, cuts, growing, asked = {kind: BoostedTrees() for kind in KINDS}, {}, {}, {}
    for kind in KINDS:
        no, yes = number[kind][False], number[kind][True]
        trees[kind].start = odds(no, yes)
        if no and yes:
            cuts[kind] = [edges_of(*side, bins) for side in of[kind]]
            growing[kind] = grown(trees[kind], cuts[kind])
            asked[kind] = next(growing[kind])
    while asked:
        sums = _summed(taught, trees, asked, cuts)
        for kind in list(asked):
            try:
                asked[kind] = growing[kind].send(sums[kind])
            except StopIteration:
                del asked[kind]

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, x, y, n in _by_kind(batches):
            at = np.floor(trees[kind].probability(x) * STEPS).astype(np.int64) * 2 + y.astype(np.int64)
            count = np.zeros(2 * STEPS + 2, np.int64)
            np.add.at(count, at, n)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(some)), pa.array(some), pa.array(count[some])], names=["kind", "at", "n"])

    held = {kind: np.zeros((STEPS + 1, 2), np.int64) for kind in KINDS}
    judged = table.where("held").select("kind", "x", "y", "n").mapInArrow(stepped, "kind string, at long, n long")
    for r in judged.groupBy("kind", "at").agg(F.sum("n").alias("n")).collect():
        held[r["kind"]][r["at"] // 2, r["at"] % 2] = r["n"]
    return Judge(trees, held, precision)


def _by_kind(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, x, y, weights) of batches of (kind, x, y, n)."""
    for batch in batches:
        kinds = np.array(batch.column(0).to_pylist())
        x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
        y, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        for kind in np.unique(kinds):
            own = kinds == kind
            yield str(kind), x[own], y[own].astype(float), n[own]


def _summed(rows: DataFrame, trees: dict[str, BoostedTrees], asked: dict[str, tuple | None], cuts: dict[str, list[np.ndarray]]) -> dict[str, np.ndarray]:
    """The histograms that each kind asks for, added up over all rows; each task gives one row for each kind."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for kind, x, y, n in _by_kind(batches):
            if kind in asked:
                got = histograms(trees[kind], cuts[kind], asked[kind], x, y, n)
                total[kind] = total[kind] + got if kind in total else got
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["kind", "sums"])

    out = {kind: np.zeros((2, len(FEATURES), max(map(len, cuts[kind])) + 1, 3), np.int64) for kind in asked}
    for kind, part in rows.select("kind", "x", "y", "n").mapInArrow(sums, "kind string, sums binary").collect():
        out[kind] += np.frombuffer(part, np.int64).reshape(out[kind].shape)
    return out


def personal_spans(docs: DataFrame, judge: Judge, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of personal data in every whole text: (``key``, base, added), arrays of (start, end, kind) in code points.

    base holds the matches of the base patterns that pass their tests; added holds further candidates that the judge
    accepts, none of which overlaps a base span or another. Defined cases: null and empty texts have none; very long texts
    are read whole; rows that repeat are scanned each; of equally likely overlapping candidates the first in the text
    stays; null keys come back as null; an empty table gives an empty result; other columns are not looked at.
    """

    def find(texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
        for t in texts:
            base = base_spans(t)
            more = [s for s in candidates(t) if not any(s[0] < e and a < s[1] for a, e, _ in base)]
            yield base, judge.accept(more, np.array([describe(t, s) for s in more])) if more else []

    return scan(docs, find, key, text)
