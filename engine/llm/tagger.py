"""A character tagger for personal data: bidirectional LSTM, linear-chain CRF, windows and their reconciliation, all in numpy.

The weights in tagger.npz were trained by train_tagger.py. Input of a character: its class and the roles that the lexicon gives to its word.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
TAGS, HIDDEN, CLASSES = len(KINDS) + 1, 32, 160
WINDOW, STRIDE, BATCH = 384, 272, 256
CJK_OF_ADDRESSES = "省市区县路街道巷号院楼室栋幢大"
WORD = re.compile(r"[^\W\d_]{3,}")
#: Taken from the score of "no span" in decoding: a span missed costs more than one that the exact check drops.
LEAN = 2.5


def _class_table() -> np.ndarray:
    """The class of each code point: ASCII as it is, full-width forms as ASCII, others by kind."""
    t = np.full(0x110000, 155, np.uint8)
    t[:128] = np.arange(128)
    t[0xC0:0xDF], t[0xDF:0x250] = 128, 129
    t[0x100:0x180:2] = 128
    t[0x370:0x2000] = 150
    t[0x200B:0x2010] = t[0xFEFF] = t[0xAD] = 153
    t[0xA0] = t[0x202F] = t[0x3000] = 32
    t[0x2000:0x200B] = 32
    t[0x3001:0x3040] = 154
    t[0x3400:0xA000] = 130
    t[0xFF01:0xFF5F] = np.arange(0x21, 0x7F)
    for i, c in enumerate(CJK_OF_ADDRESSES):
        t[ord(c)] = 131 + i
    return t


CLASS = _class_table()


def encode(text: str, given: Callable[[str], bool], family: Callable[[str], bool]) -> np.ndarray:
    """For each character, four times its class plus the roles of its word."""
    codes = CLASS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32) * 4
    for m in WORD.finditer(text):
        w = m[0].lower()
        if role := given(w) + 2 * family(w):
            codes[m.start() : m.end()] += role
    return codes


class Tagger:
    """table: rows of input of both directions, the recurrent weights u, the output w and b, and the transitions a."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        chars, roles = weights["chars"], weights["roles"]
        self.table = [np.ascontiguousarray((chars[d][:, None] + roles[d][None]).reshape(CLASSES * 4, 4 * HIDDEN).astype(np.float32)) for d in (0, 1)]
        self.u, self.w, self.b, self.a = (weights[k].astype(np.float32) for k in "uwba")

    @classmethod
    def load(cls, path: str | Path = Path(__file__).with_name("tagger.npz")) -> Tagger:
        with np.load(path) as z:
            return cls({k: z[k] for k in z.files})

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """x: (T, B) input rows; out come (T, B, TAGS) scores."""
        t, n = x.shape
        h = np.empty((t, n, 2 * HIDDEN), np.float32)
        for d, order in ((0, range(t)), (1, range(t - 1, -1, -1))):
            s, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for i in order:
                z = self.table[d][x[i]]
                z += s @ self.u[d]
                np.tanh(z, out=z)
                gates = z[:, : 3 * HIDDEN]
                gates *= 0.5
                gates += 0.5
                c *= gates[:, HIDDEN : 2 * HIDDEN]
                c += gates[:, :HIDDEN] * z[:, 3 * HIDDEN :]
                s = np.tanh(c)
                s *= gates[:, 2 * HIDDEN :]
                h[i, :, d * HIDDEN : (d + 1) * HIDDEN] = s
        return (h.reshape(-1, 2 * HIDDEN) @ self.w + self.b).reshape(t, n, TAGS)

    def viterbi(self, e: np.ndarray, lean: float = LEAN) -> np.ndarray:
        """The best tags, (T, B), of emissions (T, B, TAGS), which are leant towards spans."""
        t, n, _ = e.shape
        e = np.ascontiguousarray(e.transpose(0, 2, 1))  # long runs of memory along the batch
        e[:, 0] -= lean
        back = np.empty((t, TAGS, n), np.int8)
        a = self.a[:, :, None]
        score = e[0]
        for i in range(1, t):
            s = score[:, None] + a
            back[i] = s.argmax(axis=0)
            score = s.max(axis=0)
            score += e[i]
        tags = np.empty((t, n), np.int8)
        tags[-1] = score.argmax(axis=0)
        rows = np.arange(n)
        for i in range(t - 1, 0, -1):
            tags[i - 1] = back[i, tags[i], rows]
        return tags

    def spans(self, inputs: list[np.ndarray]) -> list[list[tuple[int, int, str]]]:
        """Of each text, given as its input rows, the disjoint spans with their kinds, in order.

        Each text is cut into windows that overlap by more than the longest span; windows of like length are decoded together.
        """
        windows = [(k, at) for k, x in enumerate(inputs) for at in range(0, max(1, len(x) - (WINDOW - STRIDE)), STRIDE)]
        windows.sort(key=lambda w: min(WINDOW, len(inputs[w[0]]) - w[1]))
        raw: list[list[tuple[int, int, int]]] = [[] for _ in inputs]
        for i in range(0, len(windows), BATCH):
            part = windows[i : i + BATCH]
            long = min(WINDOW, max(len(inputs[k]) - at for k, at in part))
            if long <= 0:
                continue
            x = np.full((long, len(part)), 10 * 4, np.int32)
            for j, (k, at) in enumerate(part):
                own = inputs[k][at : at + WINDOW]
                x[: len(own), j] = own
            tags = self.viterbi(self.emissions(x)).T
            edge = np.zeros((len(part), long + 1), bool)
            edge[:, 1:-1] = tags[:, 1:] != tags[:, :-1]
            edge[:, 0] = edge[:, -1] = True
            for j in np.flatnonzero((tags > 0).any(axis=1)):
                cuts = np.flatnonzero(edge[j])
                k, at = part[j]
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if kind := int(tags[j, a]):
                        raw[k].append((at + a, min(at + b, len(inputs[k])), kind))
        return [reconcile(s) for s in raw]


def reconcile(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """Spans of all windows of a text made into disjoint ones: what windows say alike or continue is joined, and of unlike kinds the longer holds."""
    best: list[tuple[int, int, int]] = []
    for a, b, kind in sorted(spans):
        while best and a < best[-1][1] or best and a == best[-1][1] and kind == best[-1][2]:
            p, q, k = best[-1]
            if k == kind:
                a, b = p, max(b, q)
                best.pop()
            elif q - p >= b - a:
                a = b
                break
            else:
                best.pop()
        if a < b:
            best.append((a, b, kind))
    return [(a, b, KINDS[k - 1]) for a, b, k in best]
