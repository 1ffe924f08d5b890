"""Secret scan: three rules, and a character-level convolutional network over all candidates.

A candidate is a run of 16 or more characters of tokens. The network reads it together with
its surroundings, as characters, a long one by windows that overlap and leave nothing out; the
best window counts. It is trained on the windows of labelled findings: those that a rule
confirms against those of candidates that none does, on all of either. These are dealt to shards of
bounded size; in every epoch each shard takes the same network through its own windows, and the
networks they come to are averaged. Where one label has fewer windows than its share of the shards,
several shards get the same ones. The scores are calibrated on all findings held back, and the threshold is
the highest that still finds RECALL of the held-back secrets. Scoring is row by row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmine.llm.common import ranked, saved, texts

ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "network")

SHARD, HOLD = 2250, 4  # windows of either label in a shard; one of how many is held back
BEFORE, INSIDE, AFTER = 24, 48, 8
STEP, SCORED = 16, 4096
WIDTH, EMBED, FILTERS, HIDDEN_RATE = 5, 8, 16, 0.01
EPOCHS, BATCH = 6, 128
NEWTON, SETTLED = 50, 1e-9
RECALL = 0.98
FEWEST = 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of what the rules find, by start and kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def _covered(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[list[tuple[int, int]]]:
    """What base spans cover of each of the spans, both in order of start, as separate ranges."""
    merged: list[list[int]] = []
    for start, _, end in base:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    i, out = 0, []
    for start, end in spans:
        while i < len(merged) and merged[i][1] <= start:
            i += 1
        ranges, j = [], i
        while j < len(merged) and merged[j][0] < end:
            ranges.append((max(start, merged[j][0]), min(end, merged[j][1])))
            j += 1
        out.append(ranges)
    return out


def parts(start: int, end: int) -> Iterator[tuple[int, int]]:
    """A candidate as it is or, if it is long, ranges of INSIDE characters, STEP apart, to its end."""
    if end - start <= INSIDE:
        yield start, end
        return
    for at in range(start, end - INSIDE, STEP):
        yield at, at + INSIDE
    yield end - INSIDE, end


def window(text: str, start: int, end: int) -> bytes:
    """Fixed-length codes of a part in its place: what precedes it, its characters, what follows.
    Other than ASCII counts as one character."""
    pieces = (text[max(0, start - BEFORE):start].rjust(BEFORE, "\0"), text[start:end].ljust(INSIDE, "\0"), text[end:end + AFTER].ljust(AFTER, "\0"))
    return "".join(pieces).encode("ascii", "replace")


class Network:
    """Embedding, one convolution, maximum over places, one output; plain numpy."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        place = np.zeros((BEFORE + INSIDE + AFTER, 1), np.float32)
        place[BEFORE:BEFORE + INSIDE] = 1
        self.place = place  # tells the candidate from its surroundings
        depth = WIDTH * (EMBED + 1)
        self.p = {
            "embed": rng.normal(0, 0.3, (128, EMBED)).astype(np.float32),
            "conv": rng.normal(0, depth ** -0.5, (depth, FILTERS)).astype(np.float32),
            "shift": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, FILTERS ** -0.5, FILTERS).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        self.slope, self.offset, self.threshold = 1.0, 0.0, 0.5

    def state(self) -> np.ndarray:
        """Parameters and what Adam keeps of their gradients, as one vector."""
        return np.concatenate([v.ravel() for held in (self.p, self.mean, self.square) for v in held.values()]).astype(np.float64)

    def restore(self, state: np.ndarray) -> None:
        at = 0
        for held in (self.p, self.mean, self.square):
            for k, v in held.items():
                held[k] = state[at:at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size

    def _forward(self, codes: np.ndarray) -> tuple:
        n, length = codes.shape
        x = np.concatenate([self.p["embed"][codes], np.broadcast_to(self.place, (n, length, 1))], axis=2)
        spans = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, length - WIDTH + 1, -1)
        maps = spans @ self.p["conv"] + self.p["shift"]
        at = maps.argmax(axis=1)
        top = np.take_along_axis(maps, at[:, None], axis=1)[:, 0]
        return spans, at, top, np.maximum(top, 0) @ self.p["out"] + self.p["bias"]

    def raw(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i:i + 512])[3] for i in range(0, len(codes), 512)]) if len(codes) else np.zeros(0)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self.calibrated(self.raw(codes))

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        """Probabilities."""
        return 1 / (1 + np.exp(-np.clip(self.slope * raw.astype(np.float64) + self.offset, -40, 40)))

    def _gradients(self, codes: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        spans, at, top, raw = self._forward(codes)
        n = len(codes)
        error = ((1 / (1 + np.exp(-np.clip(raw, -40, 40))) - truth) / n).astype(np.float32)
        d_top = error[:, None] * self.p["out"] * (top > 0)
        hit = spans[np.arange(n)[:, None], at]  # the span that each filter chose: n, filters, depth
        d_conv = np.einsum("nfd,nf->df", hit, d_top)
        d_hit = (d_top[:, :, None] * self.p["conv"].T[None]).reshape(n, FILTERS, WIDTH, EMBED + 1)[..., :EMBED]
        d_embed = np.zeros_like(self.p["embed"])
        chosen = codes[np.arange(n)[:, None, None], at[:, :, None] + np.arange(WIDTH)]
        np.add.at(d_embed, chosen.ravel(), d_hit.reshape(-1, EMBED))
        return {"embed": d_embed, "conv": d_conv, "shift": d_top.sum(axis=0), "out": np.maximum(top, 0).T @ error, "bias": error.sum(keepdims=True)}

    def fit(self, codes: np.ndarray, truth: np.ndarray, epoch: int) -> None:
        """One epoch, the first being 0."""
        rng = np.random.default_rng(1)
        for _ in range(epoch + 1):
            order = rng.permutation(len(codes))
        starts = range(0, len(order), BATCH)
        for step, i in enumerate(starts, epoch * len(starts) + 1):
            part = order[i:i + BATCH]
            for k, g in self._gradients(codes[part], truth[part]).items():
                self.mean[k] = 0.9 * self.mean[k] + 0.1 * g
                self.square[k] = 0.999 * self.square[k] + 0.001 * g * g
                self.p[k] = self.p[k] - HIDDEN_RATE * (self.mean[k] / (1 - 0.9 ** step)) / (np.sqrt(self.square[k] / (1 - 0.999 ** step)) + 1e-8)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows with their labels. A part beside what a rule confirms of its candidate has none."""
    def found(text: str) -> Iterator[tuple[bool, bytes]]:
        spans = candidates(text)
        for (start, end), known in zip(spans, _covered(spans, base_spans(text))):
            i = 0
            for low, high in parts(start, end):
                while i < len(known) and known[i][1] <= low:
                    i += 1
                secret = i < len(known) and known[i][0] < high
                if secret or not known:
                    yield secret, window(text, low, high)

    for batch in batches:
        rows = (row for text in batch.column("text").to_pylist() for row in found(text))
        while some := list(islice(rows, SCORED)):
            labels, windows = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.bool_()), pa.array(windows, pa.binary())], ["secret", "codes"])


def _codes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BEFORE + INSIDE + AFTER)


def _shards(sizes: dict[bool, int]) -> int:
    return -(-max(sizes.values()) // SHARD)


def dealt(shown: DataFrame, sizes: dict[bool, int]) -> DataFrame:
    """``[secret, at, codes, shard]``: every window, numbered ``at`` from 0 in its label, in one shard or more.

    ``sizes`` are the labels' numbers of windows. A shard has SHARD windows of a label at most, and of each label
    as many as any other shard, give or take one."""
    shards = _shards(sizes)
    copies = {k: shards * min(SHARD, n) // n for k, n in sizes.items()}
    mine = F.when(F.col("secret"), copies[True]).otherwise(copies[False])
    places = F.transform(F.sequence(F.lit(0), mine - 1), lambda i: (F.col("at") * mine + i) % shards)
    return shown.select("secret", "at", "codes", F.explode(places).alias("shard"))


def _epoch(state: np.ndarray, epoch: int):
    """What a shard's windows make of a network in one epoch."""
    def learn(shard: pa.Table) -> pa.Table:
        rows = shard.sort_by([("secret", "ascending"), ("at", "ascending")])
        network = Network()
        network.restore(state)
        network.fit(_codes(rows.column("codes")), rows.column("secret").to_numpy().astype(np.float64), epoch)
        return pa.table({"i": pa.array(np.arange(len(state)), pa.int32()), "v": pa.array(network.state(), pa.float64())})

    return learn


def fit(windows: DataFrame, shards: int) -> Network:
    """A network of the windows that are dealt to shards. Each epoch, the mean of their networks comes to the driver."""
    network = Network()
    for epoch in range(EPOCHS):
        learned = windows.groupBy("shard").applyInArrow(_epoch(network.state(), epoch), "i int, v double")
        # decimal sums don't depend on their order
        sums = learned.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,28)")).alias("v"))
        state = np.zeros(len(network.state()))
        for r in sums.collect():  # a row for each number of the network's state
            state[r.i] = float(r.v) / shards
        network.restore(state)
    return network


def _judged(network: Network):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = network.raw(_codes(batch.column("codes"))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("secret"), batch.column("codes"), pa.array(raw, pa.float64())], ["secret", "codes", "raw"])

    return judge


def calibrate(network: Network, hidden: DataFrame, sizes: dict[bool, int]) -> None:
    """Logistic calibration by Newton steps, then the highest threshold with enough recall, both over all of ``[secret, codes]``."""
    held = saved(hidden.select("secret", "codes").mapInArrow(_judged(network), "secret boolean, codes binary, raw double"), "held")
    soft = F.when(F.col("secret"), 1 - 1 / (sizes[True] + 2)).otherwise(1 / (sizes[False] + 2))  # keeps the slope finite
    ab, x = np.array([1.0, 0.0]), F.col("raw")
    for _ in range(NEWTON):
        z = F.least(F.greatest(x * float(ab[0]) + float(ab[1]), F.lit(-40.0)), F.lit(40.0))
        rows = held.withColumn("p", 1 / (1 + F.exp(-z))).withColumn("w", F.col("p") * (1 - F.col("p"))).withColumn("e", F.col("p") - soft)
        terms = (F.col("w") * x * x, F.col("w") * x, F.col("w"), F.col("e") * x, F.col("e"))
        xx, x1, one, ex, e = (float(v) for v in rows.agg(*(F.sum(t.cast("decimal(38,20)")) for t in terms)).first())
        step = np.linalg.solve(np.array([[xx, x1], [x1, one]]) + 1e-6 * np.eye(2), np.array([ex, e]))
        ab = ab - np.clip(step, -1, 1)
        if np.abs(step).max() < SETTLED:
            break
    network.slope, network.offset = ab.tolist()
    secrets = held.where("secret").withColumn("order", x if network.slope >= 0 else -x)
    least = ranked(secrets, "secret", ["order", "codes"]).where(F.col("at") == F.floor(F.col("size") * (1 - RECALL)))
    network.threshold = float(network.calibrated(np.array([least.first().raw]))[0])


def train(docs: DataFrame) -> Network | None:
    """A network of the candidates' windows in ``[text]``; None if either label is on fewer than
    FEWEST windows. All different windows of either label are used, one of HOLD to calibrate."""
    found = saved(docs.select("text").mapInArrow(_labelled, "secret boolean, codes binary").distinct(), "windows")
    counted = {r.secret: r["count"] for r in found.groupBy("secret").count().collect()}
    if min(counted.get(k, 0) for k in (False, True)) < FEWEST:
        return None
    rows = ranked(found.withColumn("hash", F.xxhash64("codes")), "secret", ["hash", "codes"])
    turn, before = (F.col("at") + 1) % HOLD, F.floor((F.col("at") + 1) / HOLD)  # how many are held back up to here
    hidden = {k: n // HOLD for k, n in counted.items()}
    shown = {k: n - hidden[k] for k, n in counted.items()}
    windows = saved(dealt(rows.where(turn != 0).withColumn("at", F.col("at") - before), shown), "dealt")
    network = fit(windows, _shards(shown))
    calibrate(network, rows.where(turn == 0), hidden)
    return network


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _found(network: Network, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> dict[int, list[tuple[int, int, int]]]:
    """By text, the candidates that the rules leave a part of and that have a window over the threshold."""
    def windows() -> Iterator[tuple[tuple[int, int, int], bytes]]:
        for i, text in enumerate(texts):
            spans = candidates(text)
            for (start, end), known in zip(spans, _covered(spans, bases[i])):
                if known != [(start, end)]:
                    for part in parts(start, end):
                        yield (i, start, end), window(text, *part)

    more: dict[int, list[tuple[int, int, int]]] = {}
    rows, last = windows(), None
    while some := list(islice(rows, SCORED)):
        codes = np.frombuffer(b"".join(c for _, c in some), np.uint8).reshape(len(some), -1)
        for at in np.flatnonzero(network.scores(codes) >= network.threshold).tolist():
            if some[at][0] != last:  # one window is enough
                last = i, start, end = some[at][0]
                more.setdefault(i, []).append((start, 3, end))
    return more


def _scanner(network: Network | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("text").to_pylist()
            bases = [base_spans(text) for text in found]
            more = _found(network, found, bases) if network else {}
            counts = [[sum(s[1] == kind for s in spans) for spans in bases] for kind in range(3)]
            digests = [hashlib.sha256(_named(spans).encode()).hexdigest() for spans in bases]
            joined = [_named(sorted(spans + more.get(i, []))) for i, spans in enumerate(bases)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(joined, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return scan


def secrets(docs: DataFrame) -> DataFrame:
    """``[doc_id, n_assign, n_access, n_hex, base_sha256, spans]`` of every row.

    ``spans`` has what the rules find and, as ``network``, the candidates not wholly covered by
    these that the network takes for secrets. Null and empty texts have no span; rows that repeat, or lack
    an id, are each scanned. Without enough labelled findings the rules stand alone. An empty
    table gives an empty result; other columns are ignored."""
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _scanner(train(rows)),
        f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    )
