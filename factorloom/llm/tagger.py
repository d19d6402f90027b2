"""Character-level bidirectional LSTM with a conditional random field, in numpy.

Training runs on labelled spans in generated sentences: every span is written by the generator, so its
labels are exact. Everything is seeded: the same weights come out each time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: O, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
_SPECIAL = "@.+-() :=_%,\"'/\n[]"
#: Letters of "at" and "dot", and the other hexadecimal ones as one, are told from other small letters.
_LETTERS = "atdo"
N_CLASSES = 6 + len(_SPECIAL) + len(_LETTERS)
_CLASS = np.full(256, 4, np.int16)
for _c in range(256):
    _s = chr(_c)
    if _s in _SPECIAL:
        _CLASS[_c] = 5 + _SPECIAL.index(_s)
    elif "0" <= _s <= "9":
        _CLASS[_c] = 2
    elif _s.isalpha():
        _CLASS[_c] = 1 if _s.isupper() else 0
        if _s in _LETTERS:
            _CLASS[_c] = 6 + len(_SPECIAL) + _LETTERS.index(_s)
        elif _s in "bcef":
            _CLASS[_c] = 5 + len(_SPECIAL)


def classes(text: str) -> np.ndarray:
    """The class of each code point: small letter (some by themselves), capital, digit, other letter, other, or one of the special characters."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.full(len(codes), 3, np.int16)
    low = codes < 256
    out[low] = _CLASS[codes[low]]
    return out


@dataclass
class Weights:
    x: np.ndarray  # [2][N_CLASSES][4H]: input weights of both directions, bias included
    h: np.ndarray  # [2][H][4H]
    out: np.ndarray  # [2H][TAGS]
    bias: np.ndarray  # [TAGS]
    move: np.ndarray  # [TAGS][TAGS]: score of a tag behind a tag
    first: np.ndarray  # [TAGS]

    def arrays(self) -> list[np.ndarray]:
        return [self.x, self.h, self.out, self.bias, self.move, self.first]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(codes: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: bool):
    """codes [T][B]; hidden states [T][B][H], and what the backward pass needs."""
    steps, batch = codes.shape
    size = wh.shape[0]
    h, c = np.zeros((batch, size), wx.dtype), np.zeros((batch, size), wx.dtype)
    out, saved = np.empty((steps, batch, size), wx.dtype), []
    for t in range(steps):
        z = wx[codes[t]] + h @ wh
        gates = _sigmoid(z[:, : 3 * size])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        g = np.tanh(z[:, 3 * size :])
        before, h_before = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            saved.append((i, f, o, g, before, tc, h_before))
    return out, saved


def _lstm_back(codes, saved, wh, grad, gx, gh):
    size = wh.shape[0]
    dh_next, dc_next = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    for t in range(len(codes) - 1, -1, -1):
        i, f, o, g, before, tc, h_before = saved[t]
        dh = grad[t] + dh_next
        dc = dc_next + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        one = np.zeros((len(dz), N_CLASSES), dz.dtype)
        one[np.arange(len(dz)), codes[t]] = 1
        gx += one.T @ dz
        gh += h_before.T @ dz
        dh_next, dc_next = dz @ wh.T, dc * f


def emissions(codes: np.ndarray, w: Weights) -> np.ndarray:
    """[T][B][TAGS] for codes [T][B]."""
    ahead, _ = _lstm(codes, w.x[0], w.h[0], False)
    back, _ = _lstm(codes[::-1], w.x[1], w.h[1], False)
    return np.concatenate([ahead, back[::-1]], axis=2) @ w.out + w.bias


def decode(scores: np.ndarray, w: Weights) -> np.ndarray:
    """The best tags [T][B]."""
    steps, batch, _ = scores.shape
    best, back = scores[0] + w.first, np.empty((steps, batch, TAGS), np.int8)
    for t in range(1, steps):
        each = best[:, :, None] + w.move
        back[t] = each.argmax(axis=1)
        best = each.max(axis=1) + scores[t]
    tags = np.empty((steps, batch), np.int8)
    tags[-1] = best.argmax(axis=1)
    row = np.arange(batch)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = back[t][row, tags[t]]
    return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _step(codes: np.ndarray, tags: np.ndarray, w: Weights) -> tuple[float, list[np.ndarray]]:
    """Mean negative log likelihood and its gradients."""
    steps, batch = codes.shape
    ahead, saved_a = _lstm(codes, w.x[0], w.h[0], True)
    back, saved_b = _lstm(codes[::-1], w.x[1], w.h[1], True)
    hidden = np.concatenate([ahead, back[::-1]], axis=2)
    e = hidden @ w.out + w.bias
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + w.first
    for t in range(1, steps):
        alpha[t] = _log_sum(alpha[t - 1][:, :, None] + w.move, 1) + e[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum(w.move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _log_sum(alpha[-1], 1)
    de = np.exp(alpha + beta - total[:, None])
    row = np.arange(batch)
    gold = w.first[tags[0]].sum() + sum(e[t][row, tags[t]].sum() for t in range(steps)) + w.move[tags[:-1], tags[1:]].sum()
    first = de[0].sum(axis=0) - np.bincount(tags[0], minlength=TAGS)
    move = np.zeros_like(w.move)
    for t in range(1, steps):
        move += np.exp(alpha[t - 1][:, :, None] + w.move + (e[t] + beta[t] - total[:, None])[:, None, :]).sum(axis=0)
    np.subtract.at(move, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    t_index = np.repeat(np.arange(steps), batch)
    de[t_index, np.tile(row, steps), tags.ravel()] -= 1
    de /= batch
    d_hidden = de @ w.out.T
    size = w.h.shape[1]
    gx, gh = np.zeros_like(w.x), np.zeros_like(w.h)
    _lstm_back(codes, saved_a, w.h[0], d_hidden[:, :, :size], gx[0], gh[0])
    _lstm_back(codes[::-1], saved_b, w.h[1], d_hidden[::-1, :, size:], gx[1], gh[1])
    flat = hidden.reshape(-1, 2 * size)
    grads = [gx, gh, flat.T @ de.reshape(-1, TAGS), de.sum(axis=(0, 1)), move / batch, first / batch]
    return float((total.sum() - gold) / batch), grads


# --- labelled spans -----------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


class Generator:
    """Sentences with labelled spans: all kinds in several spellings, side by side too, and look-alikes that are none."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def n(self, low: int, high: int) -> int:
        return int(self.rng.integers(low, high))

    def one(self, of):
        return of[self.n(0, len(of))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def word(self, low: int = 1, high: int = 11) -> str:
        letters = "etaoinsrhldcumfgypwbvké" if self.n(0, 6) else "éèêçäöüñíóßaeiou"
        out = "".join(self.one(letters) for _ in range(self.n(low, high if self.n(0, 30) else 60)))
        return out.capitalize() if not self.n(0, 5) else out

    def name(self) -> str:
        return "".join(self.one("abcdefghijklmnopqrstuvwxyz") for _ in range(self.n(2, 9)))

    def email(self) -> str:
        left = self.name() + self.one(["", ".", "_", "-", "+"]) + self.one([self.name(), self.digits(self.n(1, 4))])
        host = self.one(["", "mail", "mx-"]) + self.one([self.name(), self.digits(1)]) + self.one(["", "." + self.name()])
        end = self.one(["com", "org", "net", "example.com", "de", "fr", "co.uk"])
        if self.n(0, 2):
            return f"{left}@{host}.{end}"
        # spellings that no pattern of plain addresses has
        at = self.one([" at ", " [at] ", "[at]", " (at) ", "(at)", " AT ", " @ "])
        dot = self.one([" dot ", " [dot] ", "[dot]", "(dot)", " (dot) "]) if at in (" at ", " AT ") or self.n(0, 2) else "."
        return left.replace(".", "") + at + (f"{host}.{end}").replace(".", dot)

    def ip(self) -> str:
        if not self.n(0, 4):
            groups = [f"{self.n(0, 1 << 16):x}" for _ in range(8)]
            return ":".join(groups) if self.n(0, 2) else ":".join(groups[: self.n(1, 4)]) + "::" + ":".join(groups[: self.n(1, 4)])
        return self.one([".", ".", "[.]", "(.)", " . "]).join(str(self.n(0, 256)) for _ in range(4))

    def card(self) -> str:
        n = self.one([16, 16, 16, 15, 13, 19])
        body = self.one("3456") + self.digits(n - 2)
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        sep = self.one(["", "", " ", "-", ".", "  ", " - ", "/", "_"])
        return sep.join(body[i : i + 4] for i in range(0, n, 4))

    def phone(self) -> str:
        a, b, c, d = self.digits(3), self.digits(3), self.digits(4), self.digits(2)
        return self.one([
            f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+{self.n(20, 99)} {a} {b}{c}", f"+1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"+{self.n(10, 99)}{a}{b}{c}", f"+1.{a}.{b}.{c}",
            f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"0{a} {b}{c}", f"0{a}/{b}{c}", f"0{a}-{b}{c}", f"00{self.n(30, 50)} {a} {b}{c}", f"0{d[0]} {d} {d[::-1]} {c[:2]} {c[2:]}", f"1-{a}-{b}-{c}",
        ])

    def other(self) -> str:
        hexed = "".join(self.one("0123456789abcdef") for _ in range(self.n(12, 33)))
        return self.one([
            f"password={hexed}", f'token = "{hexed}"', f"key: {hexed}", self.digits(self.n(1, 8)), f"{self.digits(self.n(1, 4))}.{self.digits(self.n(1, 3))}",
            f"{self.n(1, 29)}.{self.n(1, 13)}.{self.n(1900, 2030)}", f"{self.n(1900, 2030)}-{self.n(10, 13)}-{self.n(10, 29)}", f"version {self.n(1, 9)}.{self.n(0, 9)}.",
            f"v{self.n(1, 9)}.{self.n(0, 30)}.{self.n(0, 30)}", f"@{self.name()}", f"{self.n(1, 99)}%", f"{self.n(1, 24)}:{self.n(10, 60)}", f"+{self.n(1, 99)}", f"({self.n(1, 99)})",
            f"{self.digits(self.n(1, 3))},{self.digits(3)}", "CC BY-NC 4.0.", hexed, f"{self.n(1, 200)}.{self.digits(3)}.{self.digits(3)}", f"{self.n(1, 200)} {self.digits(3)}", f"{self.n(1, 999)}-{self.n(1, 999)}",
            f"{self.n(1, 13)}/{self.n(1, 29)}/{self.n(1900, 2030)}", f"{self.n(10, 24)}:{self.n(10, 60)}:{self.n(10, 60)}", f"{self.name()} at {self.name()}", f"at {self.n(1, 13)}", f"the dot {self.name()}", f"[{self.n(1, 99)}]",
            f"{self.n(1900, 2030)}-{self.n(10, 13)}-{self.n(10, 29)} {self.n(10, 24)}:{self.n(10, 60)}", f"{self.digits(4)} {self.digits(4)}", f"{self.name()}-{self.digits(6)}", f"#{self.digits(self.n(3, 13))}", f"{self.digits(3)}-{self.digits(10)}",
        ])

    def sentence(self, length: int) -> tuple[str, np.ndarray]:
        text, tags = "", []
        while len(text) < length:
            pick = self.n(0, 10)
            if pick < 4:
                kind = self.n(0, 4)
                part = getattr(self, KINDS[kind])()
                mark = [2 + 2 * kind] * len(part)
                mark[0] = 1 + 2 * kind
            else:
                part = self.other() if pick == 4 else self.word()
                mark = [0] * len(part)
            gap = self.one([" ", " ", " ", " ", " ", "  ", ", ", ".\n", ". ", ": ", "\n", " | "])
            text, tags = text + part + gap, tags + mark + [0] * len(gap)
        at = self.n(0, len(text) - length + 1)
        return text[at : at + length], np.array(tags[at : at + length], np.int8)


@lru_cache(maxsize=4)
def train(hidden: int = 16, steps: int = 260, batch: int = 96, length: int = 80, seed: int = 11) -> Weights:
    rng, make = np.random.default_rng(seed), Generator(seed)
    weights = Weights(
        rng.normal(0, 0.3, (2, N_CLASSES, 4 * hidden)).astype(np.float32), rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden)).astype(np.float32),
        rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, TAGS)).astype(np.float32), np.zeros(TAGS, np.float32),
        np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32),
    )
    weights.x[:, :, hidden : 2 * hidden] += 1
    first, second = [np.zeros_like(a) for a in weights.arrays()], [np.zeros_like(a) for a in weights.arrays()]
    pool = [make.sentence(length) for _ in range(1500)]
    codes, tags = np.stack([classes(t) for t, _ in pool], 1), np.stack([y for _, y in pool], 1)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(pool), batch)
        _, grads = _step(codes[:, pick], tags[:, pick].astype(np.int64), weights)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.03 * min(1, step / 20) * (1 - step / (steps + 1)) + 0.001
        for a, g, m, v in zip(weights.arrays(), grads, first, second):
            g = g * min(1, 5 / norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(a.dtype)
    return weights
