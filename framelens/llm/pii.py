"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The patterns give the base spans. From base spans in a bounded sample of documents (``TRAIN_DOCUMENTS``, drawn by a hash
of the text; at most ``TRAIN_WINDOWS`` windows) a tagger is trained in NumPy. It then reads whole texts in overlapping
windows of ``WINDOW`` characters. A character's scores are averaged over its windows, those in the middle of a window
counting most, and one Viterbi pass over each stretch of windows decides, so no window edge cuts a span in two. Every kind
has a digit or an at sign in each of its spans; windows without either can hold no span and are not scored.

An added span must overlap no base span and stand the kind's own test (digits, check sum, at sign), so the tagger widens
the patterns to other spellings but does not guess.

One pass without a shuffle. The model is some 20 KB and goes to all tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelens.llm.common import flat_text, runs_of_documents

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
TRAIN_DOCUMENTS, TRAIN_WINDOWS, STEPS, BATCH = 20_000, 4096, 240, 32
#: Places of a document, of spans and of other digits each, that the training sample takes windows from.
TRAIN_PLACES = 4
SPAN_MARGIN = 0.0

# --- base patterns --------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its start only: from within it the same tail would fail again
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their at signs: the local part is the whole run before it."""
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            past = domain.end()
            yield start, past
        at = text.find("@", max(past, at + 1))


def _is(kind: str, part: str) -> bool:
    digits = _digits(part)
    if kind == "ip":
        return all(len(x) <= 3 and int(x or 0) <= 255 for x in (piece.lstrip("0") for piece in part.split(".")))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind number, end`` of the patterns' matches that pass, in order."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if _is(KINDS[kind], m.group())]
    return sorted(found)


def _may_add(kind: int, part: str) -> bool:
    """The test an added span of a kind must stand."""
    if part != part.strip():
        return False
    digits = _digits(part)
    if kind == 0:
        name, at, host = part.partition("@")
        return bool(at and len(name) > 1 and len(host) > 3 and "@" not in host and not re.search(r"\s", part) and re.search(r"[A-Za-z]", host))
    if kind == 1:
        pieces = re.split(r"[.,]|\[\.\]", part)
        return len(pieces) == 4 and all(x.isascii() and x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in pieces)
    rest = re.sub(r"[0-9\s().+/-]", "", part)
    if kind == 2:
        return not rest and 13 <= len(digits) <= 19 and len(set(digits)) > 2 and luhn(digits)
    return not rest and 10 <= len(digits) <= 15 and len(set(digits)) > 2 and part[0] in "+(0"


# --- the tagger -----------------------------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
_NEVER = -1e4
SYMBOLS = 98  # printable ASCII, other white space, other letters, anything else


def _symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = np.where((codes >= 0x20) & (codes < 0x7F), codes - 0x20, np.where(codes < 0x20, 95, np.where(codes >= 0xC0, 96, 97)))
    return out.astype(np.uint8)


def _allowed() -> np.ndarray:
    """0 where a tag may follow another: inside only after begin or inside of its kind."""
    ok = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = _NEVER
        ok[[inside - 1, inside], inside] = 0
    return ok


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Tagger:
    """Embedding, one LSTM each way, a linear layer to tag scores, and CRF transitions."""

    WIDTH, HIDDEN = 16, 16

    def __init__(self, seed: int = 7):
        rng, d, h = np.random.default_rng(seed), self.WIDTH, self.HIDDEN
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": draw(SYMBOLS, d) * 3, "out": draw(2 * h, TAGS), "out_b": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}
        for way in "fb":
            self.p |= {f"w{way}": draw(d + h, 4 * h), f"b{way}": np.zeros(4 * h, np.float32)}
            self.p[f"b{way}"][h : 2 * h] = 1  # remember at first
        first = np.zeros(TAGS, np.float32)
        first[2::2] = _NEVER
        self.fixed = {"move": _allowed(), "start": first}

    def _lstm(self, x: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """Hidden states of (rows, time, width); ``way`` b runs backwards."""
        n, steps, _ = x.shape
        w, b, h = self.p[f"w{way}"], self.p[f"b{way}"], self.HIDDEN
        given = x @ w[: self.WIDTH] + b
        state, cell, out, kept = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, steps, h), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = given[:, t] + state @ w[self.WIDTH :]
            gates, new = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, held = cell, state
            cell = f * cell + i * new
            top = np.tanh(cell)
            state = o * top
            out[:, t] = state
            kept.append((t, i, f, o, new, before, top, held))
        return out, kept

    def _lstm_back(self, x: np.ndarray, way: str, kept: list, d_out: np.ndarray, grads: dict) -> np.ndarray:
        w, h = self.p[f"w{way}"], self.HIDDEN
        dz_all = np.zeros((*x.shape[:2], 4 * h), np.float32)
        d_state, d_cell, dw = np.zeros_like(d_out[:, 0]), np.zeros_like(d_out[:, 0]), np.zeros_like(w[self.WIDTH :])
        for t, i, f, o, new, before, top, held in reversed(kept):
            d_state = d_state + d_out[:, t]
            d_cell = d_cell + d_state * o * (1 - top * top)
            dz = np.concatenate([d_cell * new * i * (1 - i), d_cell * before * f * (1 - f), d_state * top * o * (1 - o), d_cell * i * (1 - new * new)], 1)
            dw += held.T @ dz
            d_state, d_cell = dz @ w[self.WIDTH :].T, d_cell * f
            dz_all[:, t] = dz
        flat = dz_all.reshape(-1, 4 * h)
        grads[f"w{way}"] = np.concatenate([x.reshape(-1, self.WIDTH).T @ flat, dw])
        grads[f"b{way}"] = flat.sum(0)
        return dz_all @ w[: self.WIDTH].T

    def scores(self, symbols: np.ndarray) -> np.ndarray:
        """Tag scores of windows (rows, time)."""
        x = self.p["embed"][symbols]
        return np.concatenate([self._lstm(x, "f")[0], self._lstm(x, "b")[0]], 2) @ self.p["out"] + self.p["out_b"]

    def moves(self) -> tuple[np.ndarray, np.ndarray]:
        return self.p["move"] + self.fixed["move"], self.p["start"] + self.fixed["start"]

    def _loss(self, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of whole windows, and its gradients."""
        x = self.p["embed"][symbols]
        (hf, kf), (hb, kb) = self._lstm(x, "f"), self._lstm(x, "b")
        both = np.concatenate([hf, hb], 2)
        e = both @ self.p["out"] + self.p["out_b"]
        move, start = self.moves()
        n, steps, _ = e.shape
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0] + start
        for t in range(1, steps):
            forward[:, t] = _logsum(forward[:, t - 1, :, None] + move, 1) + e[:, t]
        for t in range(steps - 2, -1, -1):
            backward[:, t] = _logsum(move + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        total = _logsum(forward[:, -1], 1)
        single = np.exp(forward + backward - total[:, None, None])
        joint = np.exp(forward[:, :-1, :, None] + move + (e + backward)[:, 1:, None, :] - total[:, None, None, None])
        rows, at = np.arange(n)[:, None], np.arange(steps)
        path = e[rows, at, tags].sum(1) + start[tags[:, 0]] + move[tags[:, :-1], tags[:, 1:]].sum(1)
        de = single
        de[rows, at, tags] -= 1
        d_move = joint.sum((0, 1))
        np.add.at(d_move, (tags[:, :-1], tags[:, 1:]), -1)
        grads = {"start": de[:, 0].sum(0), "move": d_move, "out": both.reshape(-1, both.shape[2]).T @ de.reshape(-1, TAGS), "out_b": de.sum((0, 1))}
        d_both = de @ self.p["out"].T
        dx = self._lstm_back(x, "f", kf, d_both[:, :, : self.HIDDEN], grads) + self._lstm_back(x, "b", kb, d_both[:, :, self.HIDDEN :], grads)
        grads["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grads["embed"], symbols, dx)
        return float((total - path).mean()), {k: g / n for k, g in grads.items()}

    def train(self, symbols: np.ndarray, tags: np.ndarray, steps: int = STEPS, rate: float = 0.015, seed: int = 11) -> list[float]:
        """Adam over shuffled batches; the loss of each step."""
        rng, first, second, losses, order = np.random.default_rng(seed), {}, {}, [], np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < BATCH:
                order = np.concatenate([order, rng.permutation(len(symbols))])
            some, order = order[:BATCH], order[BATCH:]
            loss, grads = self._loss(symbols[some], tags[some].astype(np.int64))
            losses.append(loss)
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (size + 1e-9))
                first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                second[k] = 0.98 * second.get(k, 0) + 0.02 * g * g
                change = rate * (1 - step / (steps + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.98**step)) + 1e-8)
                self.p[k] = (self.p[k] - change).astype(np.float32)
        return losses

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each stretch (time, tags); stretches step together."""
        move, start = self.moves()
        sizes = np.array([len(x) for x in scores])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        last, back = np.zeros((len(order), TAGS), np.float32), []
        for t in range(int(sizes[0])):
            k = int(np.searchsorted(-sizes, -t, side="left"))
            e = np.stack([scores[i][t] for i in order[:k]])
            if t:
                from_ = last[:k, :, None] + move
                best = from_.argmax(1)
                back.append(best)
                e = e + np.take_along_axis(from_, best[:, None], 1)[:, 0]
            else:
                e = e + start
            last[:k] = e
        state, out = last.argmax(1), [np.zeros(n, np.int64) for n in sizes]
        for t in range(int(sizes[0]) - 1, -1, -1):
            k = int(np.searchsorted(-sizes, -t, side="left"))
            for i in range(k):
                out[i][t] = state[i]
            if t:
                state[:k] = back[t - 1][np.arange(k), state[:k]]
        result = [np.zeros(0, np.int64)] * len(order)
        for i, tags in zip(order, out):
            result[i] = tags
        return result


# --- training rows --------------------------------------------------------------------------------------------------


def _training_windows(text: str, most: int = TRAIN_PLACES) -> Iterator[tuple[bytes, bytes]]:
    """Windows around base spans and around other digits and at signs, each span at a place that varies with the text.

    At most ``most`` places of each sort, spread over the text. Shorter texts are padded with white space.
    """
    spans = base_spans(text)
    text = text.ljust(WINDOW)
    symbols, tags = _symbols(text), np.zeros(len(text), np.uint8)
    for a, kind, b in sorted(spans, key=lambda s: s[0] - s[2]):
        if not tags[a:b].any():
            tags[a:b] = 2 + 2 * kind
            tags[a] = 1 + 2 * kind
    others = [m.start() for m in re.finditer("[0-9@]", text) if not tags[m.start()]]
    chosen = [a for a, _, _ in spans[:: -(-len(spans) // most) or 1]] + others[:: max(1, len(others) // min(most, max(2, len(spans))))][:most]
    for i, a in enumerate(chosen):
        start = max(0, min(a - (a * 7 + i * 13) % STRIDE, len(text) - WINDOW))
        t = tags[start : start + WINDOW].copy()
        if t[0] and t[0] % 2 == 0:  # begun before the window
            t[0] -= 1
        yield symbols[start : start + WINDOW].tobytes(), t.tobytes()


def fit(documents: DataFrame, *, documents_at_most: int = TRAIN_DOCUMENTS) -> Tagger | None:
    """Train on windows of the sample; None where it holds no base span."""
    count = documents.count()
    share = int(min(1.0, documents_at_most / max(count, 1)) * (1 << 30))
    sample = documents.where(F.col("text").isNotNull()).where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share).select("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w for _, text in _with_triggers(batch.column(0)) for w in _training_windows(text)]
            yield pa.RecordBatch.from_arrays([pa.array([w[i] for w in found], pa.binary()) for i in range(2)], names=["symbols", "tags"])

    rows = sample.mapInArrow(task, "symbols binary, tags binary").distinct().orderBy(F.xxhash64("symbols", "tags")).limit(TRAIN_WINDOWS).toArrow()
    if not rows.num_rows:
        return None
    symbols, tags = (np.frombuffer(b"".join(rows.column(x).to_pylist()), np.uint8).reshape(-1, WINDOW) for x in ("symbols", "tags"))
    if not tags.any():
        return None
    tagger = Tagger()
    tagger.train(symbols, tags)
    return tagger


# --- whole texts ----------------------------------------------------------------------------------------------------

_TRIGGER = np.zeros(256, bool)
_TRIGGER[[0x40, *range(0x30, 0x3A)]] = True


def _with_triggers(column: pa.Array) -> Iterator[tuple[int, str]]:
    """Number and text of the documents that hold a digit or an at sign."""
    data, offsets = flat_text(column)
    for a, b in runs_of_documents(offsets):
        upto = np.concatenate([[0], np.cumsum(_TRIGGER[data[offsets[a] : offsets[b]]])])
        for d in a + np.flatnonzero(np.diff(upto[offsets[a : b + 1] - offsets[a]])):
            yield int(d), data[offsets[d] : offsets[d + 1]].tobytes().decode()


_CENTRE = (1 - np.abs(np.arange(WINDOW) - (WINDOW - 1) / 2) / (WINDOW / 2 + 1)).astype(np.float32)


def _stretches(text: str) -> list[tuple[int, np.ndarray]]:
    """Start and symbols of stretches of windows that hold digits or at signs; windows begin at multiples of ``STRIDE``."""
    at = np.array([m.start() for m in re.finditer("[0-9@]", text)], np.int64)
    grid = np.unique(np.concatenate([at // STRIDE, at // STRIDE - 1]))
    grid = grid[grid >= 0] if len(text) > STRIDE else np.zeros(1, np.int64)
    cuts = np.flatnonzero(np.diff(grid) > 1) + 1
    symbols = _symbols(text)
    out = []
    for part in np.split(grid, cuts):
        start, end = int(part[0]) * STRIDE, (int(part[-1]) + WINDOW // STRIDE) * STRIDE
        out.append((start, np.pad(symbols[start:end], (0, max(0, end - max(start, len(symbols)))), constant_values=95)))
    return out


def added_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]], block: int = 2048) -> list[list[tuple[int, int, int]]]:
    """Spans the tagger adds to each text's base spans."""
    places = [(d, start, symbols) for d, text in enumerate(texts) for start, symbols in _stretches(text)]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s in range(0, len(places), block):
        part = places[s : s + block]
        windows = [symbols[a : a + WINDOW] for _, _, symbols in part for a in range(0, len(symbols) - STRIDE, STRIDE)]
        if not windows:
            continue
        raw = np.concatenate([tagger.scores(np.stack(windows[i : i + 1024])) for i in range(0, len(windows), 1024)])
        merged, k = [], 0
        for _, _, symbols in part:
            total, weight = np.zeros((len(symbols), TAGS), np.float32), np.zeros((len(symbols), 1), np.float32)
            for a in range(0, len(symbols) - STRIDE, STRIDE):
                total[a : a + WINDOW] += raw[k] * _CENTRE[:, None]
                weight[a : a + WINDOW] += _CENTRE[:, None]
                k += 1
            merged.append(total / weight)
        for (d, start, _), tags, scores in zip(part, tagger.decode(merged), merged):
            for begin in np.flatnonzero(tags % 2 == 1):
                kind, end = int(tags[begin] - 1) // 2, int(begin) + 1
                while end < len(tags) and tags[end] == 2 + 2 * kind:
                    end += 1
                a, b = start + int(begin), min(start + end, len(texts[d]))
                sure = float((scores[np.arange(begin, end), tags[begin:end]] - scores[begin:end, 0]).mean()) >= SPAN_MARGIN
                clear = all(b <= x or a >= y for x, _, y in base[d])
                if sure and clear and a < b and _may_add(kind, texts[d][a:b]):
                    found[d].append((a, kind, b))
    return found


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(documents: DataFrame, tagger: Tagger | None) -> DataFrame:
    """All rows and columns of ``documents`` with ``n_email, n_ip, n_card, n_phone, base, spans`` added.

    Counts and ``base`` are of the patterns alone; ``spans`` has the tagger's as well. Both read ``kind:start:end`` in code
    points, by start and kind, comma-joined, empty without spans. Null texts are empty. Only ``text`` is read; repeated
    rows and null ids are rows like others; columns of these names are replaced.
    """
    added = {f"n_{k}": "long" for k in KINDS} | {"base": "string", "spans": "string"}
    kept = documents.drop(*added)
    held = documents.sparkSession.sparkContext.broadcast(tagger)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, spans = np.zeros((batch.num_rows, len(KINDS)), np.int64), [""] * batch.num_rows, [""] * batch.num_rows
            some = list(_with_triggers(batch.column(batch.schema.get_field_index("text"))))
            own = [base_spans(text) for _, text in some]
            more = added_spans(held.value, [t for _, t in some], own) if held.value and some else [[] for _ in some]
            for (d, _), x, y in zip(some, own, more):
                for _, kind, _ in x:
                    counts[d, kind] += 1
                base[d], spans[d] = _join(x), _join(sorted(x + y))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(base, pa.string()), pa.array(spans, pa.string())], names=[*batch.schema.names, *added])

    schema = T.StructType([*kept.schema.fields, *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in added.items())).fields])
    return kept.mapInArrow(task, schema)


def report(documents: DataFrame) -> DataFrame:
    found = find(documents.select("doc_id", "text"), fit(documents.select("text")))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
