"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions trained on their spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import chunks
from .common import hash_sample

# Fixed by the contract: kinds in order, their patterns (runs taken whole, which changes no match) and limits.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (12, 19), (9, 15)

# The model: characters up to 127 are themselves, all others one class; padding is a class.
OTHER, PAD, CLASSES, HIDDEN, TAGS = 128, 129, 130, 8, 1 + len(KINDS)
# Fitted on at most FIT_WINDOWS windows around the spans of about FIT_DOCS documents, chosen by a seeded hash.
FIT_DOCS, FIT_WINDOWS, FIT_LENGTH, STEPS, BATCH, RATE = 4000, 3072, 96, 256, 128, 0.03
# Decoding: windows of CORE characters with MARGIN more on both sides; spans of fewer than SHORTEST are not reported.
CORE, MARGIN, SHORTEST, SURE, CHUNK_CHARS = 480, 32, 7, 2.0, 500_000


def luhn(digits: str) -> bool:
    doubled = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[::-2]) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from the @ signs so that long runs of letters cost nothing."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = floor + len(text[floor:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        floor = found.end() if found else at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256
                                                                     for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if PHONE_DIGITS[0] <= sum(c in "0123456789" for c in m.group()) <= PHONE_DIGITS[1]:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def codes_of(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), OTHER).astype(np.uint8)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Weights of both directions (leading axis 2), gates in the order input, forget, output, candidate."""

    NAMES = ("table", "loop", "out", "bias", "moves")

    def __init__(self, seed: int = 7, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.table = rng.normal(0, 0.3, (2, CLASSES, 4 * hidden)).astype(np.float32)
        self.table[:, :, hidden:2 * hidden] += 1            # remember by default
        self.loop = rng.normal(0, 0.3, (2, hidden, 4 * hidden)).astype(np.float32)
        self.out = rng.normal(0, 0.3, (2, hidden, TAGS)).astype(np.float32)
        self.bias = np.zeros(TAGS, np.float32)
        self.moves = np.zeros((TAGS, TAGS), np.float32)

    def states(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, direction, window, unit) of codes (time, window); direction 1 runs from the end."""
        steps, n, h = *codes.shape, self.hidden
        half = np.full(4 * h, 0.5, np.float32)
        half[3 * h:] = 1                                     # sigmoid(x) = tanh(x / 2) / 2 + 1/2
        table, loop = (self.table * half).reshape(-1, 4 * h), self.loop * half
        both = np.stack([codes, codes[::-1]], axis=1).astype(np.intp)
        both[:, 1] += CLASSES
        out = np.zeros((steps, 2, n, h), np.float32)
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        gates, turn = np.empty((2, n, 4 * h), np.float32), np.empty((2, n, 4 * h), np.float32)
        for t in range(steps):
            np.take(table, both[t], axis=0, out=gates, mode="clip")
            np.matmul(state, loop, out=turn)
            gates += turn
            np.tanh(gates, out=gates)
            sig = gates[..., :3 * h]
            sig *= 0.5
            sig += 0.5
            old = cell
            cell = sig[..., h:2 * h] * cell
            cell += sig[..., :h] * gates[..., 3 * h:]
            squashed = np.tanh(cell)
            np.multiply(sig[..., 2 * h:], squashed, out=out[t])
            if keep is not None:
                keep.append((gates.copy(), old, squashed, state))
            state = out[t]
        return out

    def quick_states(self, codes: np.ndarray) -> np.ndarray:
        """The same as ``states`` but for the last bits, for decoding.

        Each gate lies in one piece, (gate, direction, window, unit), so every step runs over whole blocks, and all of
        them are 1 / (1 + exp(y)), which takes half the time of tanh where numpy has no wide vectors for it.
        """
        steps, n, h = *codes.shape, self.hidden
        scale = np.array([-1, -1, -1, -2], np.float32)[:, None, None, None]      # tanh(x) = 2 / (1 + exp(-2x)) - 1
        table, loop = (np.ascontiguousarray(w.reshape(*w.shape[:2], 4, h).transpose(2, 0, 1, 3) * scale) for w in (
            self.table, self.loop))
        table = table.reshape(4, -1, h)
        both = np.stack([codes, codes[::-1]], axis=1).astype(np.intp)
        both[:, 1] += CLASSES
        out = np.empty((steps, 2, n, h), np.float32)
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        gates, turn = np.empty((4, 2, n, h), np.float32), np.empty((4, 2, n, h), np.float32)
        fresh, squashed = np.empty_like(cell), np.empty_like(cell)
        with np.errstate(over="ignore"):                     # exp may be infinite: 1 / (1 + exp(y)) is 0 then
            for t in range(steps):
                np.take(table, both[t], axis=1, out=gates, mode="clip")
                np.matmul(state, loop, out=turn)
                gates += turn
                np.exp(gates, out=gates)
                gates += 1
                np.divide(1, gates, out=gates)
                gates[3] *= 2
                gates[3] -= 1
                cell *= gates[1]
                np.multiply(gates[0], gates[3], out=fresh)
                cell += fresh
                np.multiply(cell, -2, out=squashed)
                np.exp(squashed, out=squashed)
                squashed += 1
                np.divide(2, squashed, out=squashed)
                squashed -= 1
                state = np.multiply(gates[2], squashed, out=out[t])
        return out

    def emissions(self, codes: np.ndarray, states: np.ndarray | None = None) -> np.ndarray:
        """(time, window, tag)."""
        states = self.states(codes) if states is None else states
        return states[:, 0] @ self.out[0] + states[::-1, 1] @ self.out[1] + self.bias

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood per window of the CRF, and its gradients through time."""
        steps, n = codes.shape
        h, keep = self.hidden, []
        states = self.states(codes, keep)
        scores = self.emissions(codes, states).astype(np.float64)
        moves = self.moves.astype(np.float64)
        ahead, back = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0]
        for t in range(1, steps):
            ahead[t] = scores[t] + log_sum(ahead[t - 1][:, :, None] + moves, 1)
        for t in range(steps - 2, -1, -1):
            back[t] = log_sum((scores[t + 1] + back[t + 1])[:, None, :] + moves, 2)
        total = log_sum(ahead[-1], 1)
        grad = np.exp(ahead + back - total[:, None])
        pairs = np.exp(ahead[:-1, :, :, None] + moves + (scores[1:] + back[1:])[:, :, None, :] - total[:, None, None])
        move_grad = pairs.sum(axis=(0, 1))
        np.add.at(move_grad, (tags[:-1].ravel(), tags[1:].ravel()), -1.0)
        at = (np.arange(steps)[:, None], np.arange(n)[None, :], tags)
        loss = (total - scores[at].sum(axis=0) - moves[tags[:-1], tags[1:]].sum(axis=0)).mean()
        grad[at] -= 1
        grad = (grad / n).astype(np.float32)
        both = np.stack([grad, grad[::-1]], axis=1)          # (time of the direction, direction, window, tag)
        out = {"bias": grad.sum(axis=(0, 1)), "moves": (move_grad / n).astype(np.float32),
               "out": np.einsum("tdnh,tdnk->dhk", states, both, optimize=True),
               "table": np.zeros_like(self.table), "loop": np.zeros_like(self.loop)}
        index = np.stack([codes, codes[::-1]], axis=1)
        d_state, d_cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        turned_out, turned_loop = self.out.transpose(0, 2, 1), self.loop.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            gates, old, squashed, before = keep[t]
            i, f, o, g = (gates[..., k * h:(k + 1) * h] for k in range(4))
            d_state += both[t] @ turned_out
            d_cell += d_state * o * (1 - squashed ** 2)
            d_gates = np.concatenate([d_cell * g * i * (1 - i), d_cell * old * f * (1 - f),
                                      d_state * squashed * o * (1 - o), d_cell * i * (1 - g ** 2)], axis=2)
            for d in (0, 1):
                np.add.at(out["table"][d], index[t, d], d_gates[d])
            out["loop"] += before.transpose(0, 2, 1) @ d_gates
            d_state = d_gates @ turned_loop
            d_cell = d_cell * f
        return float(loss), out

    def train(self, codes: np.ndarray, tags: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE,
              seed: int = 7) -> list[float]:
        """Adam over shuffled batches of windows (window, time), ``steps`` updates or a few more; the loss of every epoch."""
        rng, first, second, step, losses = np.random.default_rng(seed), {}, {}, 0, []
        epochs = -(-steps * batch // max(1, len(codes)))
        for epoch in range(epochs):
            order, total = rng.permutation(len(codes)), 0.0
            for i in range(0, len(order), batch):
                part = order[i:i + batch]
                loss, grads = self.gradients(codes[part].T, tags[part].T)
                total += loss * len(part)
                step += 1
                norm = np.sqrt(sum(float((g ** 2).sum()) for g in grads.values()))
                for name in self.NAMES:
                    g = grads[name] * min(1.0, 5.0 / max(norm, 1e-9))
                    first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                    second[name] = 0.999 * second.get(name, 0) + 0.001 * g * g
                    now = rate * (1 - epoch / epochs)
                    setattr(self, name, (getattr(self, name) - now * (first[name] / (1 - 0.9 ** step))
                                         / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-6)).astype(np.float32))
            losses.append(total / max(1, len(codes)))
        return losses

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (time, window) and by how much each beats the no-data tag there.

        A window in which no-data leads everywhere by more than all transitions could make up has that path as its
        best one; the others go through the Viterbi recursion.
        """
        scores = self.emissions(codes, self.quick_states(codes))
        most = scores[..., 1]
        for k in range(2, TAGS):
            most = np.maximum(most, scores[..., k])
        lead = scores[..., 0] - most
        stay = self.moves[0, 0]
        slack = (max(0, (self.moves[1:, 1:] - stay).max()) + max(0, (self.moves[0, 1:] - stay).max())
                 + max(0, (self.moves[1:, 0] - stay).max()))
        open_ = np.flatnonzero(lead.min(axis=0) <= slack)
        tags, sure = np.zeros(codes.shape, np.int8), np.zeros(codes.shape, np.float32)
        if len(open_):
            part, steps = scores[:, open_], len(codes)
            best, come = part[0], np.empty((steps, len(open_), TAGS), np.int8)
            for t in range(1, steps):
                ways = best[:, :, None] + self.moves
                come[t] = ways.argmax(axis=1)
                best = ways.max(axis=1) + part[t]
            now = best.argmax(axis=1)
            for t in range(steps - 1, -1, -1):
                tags[t, open_] = now
                if t:
                    now = come[t][np.arange(len(open_)), now]
            sure[:, open_] = np.take_along_axis(part, tags[:, open_, None].astype(np.intp), 2)[..., 0] - part[..., 0]
        return tags, sure

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, kind, end) spans of whole texts, from overlapping windows reconciled over each text.

        Runs of one tag are candidates. A run cut off by its window's edge gives way to the same run seen whole by the
        neighbour; of candidates that still overlap the surest stays, then the longest, then the leftmost.
        """
        coded = [codes_of(t) for t in texts]
        owner = [(k, s) for k, c in enumerate(coded) for s in range(0, len(c), CORE)]
        length, found = CORE + 2 * MARGIN, [[] for _ in texts]
        for i in range(0, len(owner), 2048):
            part = owner[i:i + 2048]
            codes = np.full((len(part), length), PAD, np.uint8)
            for row, (k, s) in enumerate(part):
                low, high = max(0, s - MARGIN), min(len(coded[k]), s + CORE + MARGIN)
                codes[row, low - s + MARGIN:high - s + MARGIN] = coded[k][low:high]
            tags, sure = self.decode(np.ascontiguousarray(codes.T))
            for row in np.flatnonzero(tags.any(axis=0)):
                k, s = part[row]
                line = tags[:, row]
                cuts = np.flatnonzero(np.diff(line, prepend=-1, append=-1))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if line[a]:
                        cut = (a == 0 and s > MARGIN) or (b == length and s + CORE + MARGIN < len(coded[k]))
                        found[k].append((not cut, float(sure[a:b, row].mean()), a + s - MARGIN, b + s - MARGIN, int(line[a]) - 1))
        return [reconcile(f, len(c)) for f, c in zip(found, coded, strict=True)]


def reconcile(found: list[tuple[bool, float, int, int, int]], length: int) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for _, sure, a, b, kind in sorted(set(found), key=lambda f: (-f[0], -f[1], f[2] - f[3], f[2])):
        a, b = max(a, 0), min(b, length)
        if sure >= SURE and b - a >= SHORTEST and all(b <= x or a >= y for x, _, y in out):
            out.append((a, kind, b))
    return sorted(out)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS,
        fit_windows: int = FIT_WINDOWS, seed: int = 7) -> Tagger | None:
    """Train on windows around the pattern spans of a bounded sample of documents; None if no document has any span."""
    sample = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = hash_sample(sample, fit_docs, "id", "text", seed=seed).select("text", F.xxhash64("id", "text").alias("h"))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, h in zip(batch["text"], batch["h"], strict=True):
                rng = np.random.default_rng(int(h) & 0xFFFFFFFF)
                spans, codes = base_spans(text), codes_of(text)
                tags = np.zeros(len(codes), np.uint8)
                for a, kind, b in spans:
                    tags[a:b] = kind + 1
                starts = [a - int(rng.integers(0, FIT_LENGTH - 32)) for a, _, _ in spans]
                # As many windows without data, half of them where digits are.
                digits = np.flatnonzero((codes >= 48) & (codes < 58) & (tags == 0))
                starts += [int(rng.choice(digits)) - int(rng.integers(0, FIT_LENGTH))] if len(digits) else []
                starts += [int(rng.integers(0, max(1, len(codes))))]
                for s in starts:
                    low, high = max(0, s), min(len(codes), s + FIT_LENGTH)
                    own = np.full((2, FIT_LENGTH), PAD, np.uint8)
                    own[1] = 0
                    if low < high:
                        own[0, low - s:high - s], own[1, low - s:high - s] = codes[low:high], tags[low:high]
                    rows.append((int(rng.integers(1 << 40)), bool(own[1].any()), own[0].tobytes(), own[1].tobytes()))
            yield pd.DataFrame(rows, columns=["o", "data", "codes", "tags"])

    # Copies of one document would give their window many times.
    made = sample.mapInPandas(
        windows, "o long, data boolean, codes binary, tags binary").dropDuplicates(["codes", "tags"])
    taken = [made.filter(keep).orderBy("o", "codes", "tags").limit(fit_windows // 2).toPandas() for keep in ("data", "not data")]
    if not len(taken[0]):
        return None
    rows = pd.concat(taken).sort_values(["o", "codes"])

    def matrix(name: str) -> np.ndarray:
        return np.frombuffer(b"".join(rows[name]), np.uint8).reshape(len(rows), FIT_LENGTH).astype(np.intp)

    model = Tagger(seed)
    model.train(matrix("codes"), matrix("tags"))
    return model


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def find(docs: DataFrame, model: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    Base spans are the pattern matches; the model adds spans that overlap none of them. ``spans`` lists all as
    kind:start:end in code points. Null texts count as empty: no spans, an empty list. Rows are independent (no
    shuffle), repeated rows come out alike, further columns are ignored, a model of None adds nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for i, j in chunks(texts, CHUNK_CHARS):
                base = [base_spans(t) for t in texts[i:j]]
                added = own.spans(texts[i:j]) if own else [[] for _ in base]
                both = [sorted(b + [x for x in a if all(x[2] <= y[0] or x[0] >= y[2] for y in b)])
                        for a, b in zip(added, base, strict=True)]
                counts = [pa.array([sum(k == kind for _, k, _ in b) for b in base], pa.int64()) for kind in range(len(KINDS))]
                digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), *counts, digest, pa.array(map(joined, both), pa.string())],
                    names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")
