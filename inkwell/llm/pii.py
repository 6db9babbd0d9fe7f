"""PII (operator 8): a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

A text is a sequence of characters (code points): ASCII ones stand for themselves, all others for one of `OTHERS` general kinds
(letters by case, ideographs, marks, digits, punctuation, spaces, symbols). Two LSTMs (softsign gates), one from each side, give
every character a score for each tag: outside, or inside a span of one kind. A linear-chain CRF adds transition scores; training
maximises the log-likelihood of the tags of labelled spans by back-propagation through time and Adam, and decoding is exact
(Viterbi). The labelled spans are drawn by a seeded generator: noisy multilingual carrier text with addresses, telephone numbers,
card numbers, network addresses, secrets (hexadecimal, base64, prefixed tokens, signed web tokens) and personal or account
numbers, all of randomly composed formats, and with harmless numbers and names between them. The weights that `train` gives are
kept beside this module (`python -m inkwell.llm.pii` makes them again), so queries only decode.

A text is covered whole by windows of `WINDOW` characters that overlap by `OVERLAP`. Each window is decoded on its own; spans of
one text are then reconciled together: overlapping or touching spans of a kind become one, and of overlapping spans of two kinds the longer wins, then the earlier.

Defined results: NULL and empty texts have no spans; repeated rows have equal spans; an empty table gives no rows; other columns
are not read. Offsets count characters (code points) from 0, half-open.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from pathlib import Path
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import bytesops as B

KINDS = ("EMAIL", "PHONE", "CARD", "IP", "SECRET", "ID")
TAGS = 1 + len(KINDS)
HIDDEN = 16
WINDOW, OVERLAP = 512, 112
STEP = 1 << 20
#: Windows that are decoded together, more than a step has: a pass over few lanes costs a numpy call more than its arithmetic.
LANES = 4096
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
#: Characters beyond ASCII, by their general category.
OTHERS = ("Ll", "Lu", "Lo", "M", "N", "P", "Z", "S", "C", "astral")
ALPHABET = 128 + len(OTHERS)

Params = dict[str, np.ndarray]


# Characters


def _kind_of(c: int) -> int:
    cat = unicodedata.category(chr(c))
    if cat in ("Ll", "Lu", "Lo"):
        return 128 + OTHERS.index(cat)
    return 128 + (OTHERS.index("Lo") if cat[0] == "L" else OTHERS.index(cat[0]))


_SYMBOL = np.array([c if c < 128 else _kind_of(c) for c in range(1 << 16)], np.uint8)


def characters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol of every character of UTF-8 bytes, and the byte that each begins at."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    out = buf[at]
    wide = np.flatnonzero(out >= 0x80)
    if len(wide):
        lead, first = out[wide].astype(np.int64), at[wide]
        x = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int64) & 0x3F
        two, three = lead < 0xE0, lead < 0xF0
        code = np.where(two, (lead & 0x1F) << 6 | x[first + 1], (lead & 0x0F) << 12 | x[first + 1] << 6 | x[first + 2])
        out[wide] = np.where(three, _SYMBOL[code & 0xFFFF], ALPHABET - 1)
    return out, at


# Labelled spans


_POOL = "ing tion bl wh sh ly pf zu ge be ver ung heit mi bo ll rr ga ci ja th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve qu é è ñ ó ä ö ü ß ç ción keit lich eau ment".split()
_LETTERS = "abcdefghijklmnopqrstuvwxyz" * 4 + "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßœабвгдежзиклмнопрстуαβγδεжλμ中文字漢語ひらが"
_COMMON = """the of and to in is it you that he was for on are with as his they at be this from have or by one had not but what all were when we there can an your which
their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may
long little very after words called just where most know call card phone mail email server host ping address number account client user login contact office order reply write send tel fax mobile key token secret password
payment bank paid invoice customer name date code data file test query error page home work city street der die das und ist nicht mit von auf ein eine für dem den sich auch als noch wird sind oder aber nach bei zum Telefon
Karte Konto Adresse Nummer le la les des et est une dans pour que qui sur pas avec plus par ce il elle au du carte compte adresse numéro el los las y en un por con para como más pero su al lo cuenta tarjeta número correo""".split()
_B62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_UP = _B62[:26]


def _digits(rng: Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _word(rng: Random) -> str:
    """A common word, syllables, or letters of no language, so that neither letters nor words tell of a kind by themselves."""
    if (r := rng.random()) < 0.35:
        return rng.choice(_COMMON)
    if r < 0.5:
        return _ascii(rng)
    if r < 0.65:
        return "".join(rng.choices(_LETTERS, k=rng.randint(1, 10)))
    return "".join(rng.choices(_POOL, k=rng.randint(1, 4)))


def _ascii(rng: Random) -> str:
    return "".join(rng.choices(_B62[26:52], k=rng.randint(2, 9)))


def _email(rng: Random) -> str:
    user = rng.choice("..__-+").join([_word(rng), rng.choice([_digits(rng, rng.randint(1, 4)), _word(rng)])]) if rng.random() < 0.75 else _word(rng) + rng.choice(["", _digits(rng, 2)])
    host = ".".join(rng.choice([_word(rng), _ascii(rng)]) + rng.choice(["", "", _digits(rng, 1), "-" + _ascii(rng)]) for _ in range(rng.choice([1, 1, 2, 2, 3])))
    return f"{user}@{host}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'co.uk', 'edu', 'info', _ascii(rng)[:3]])}"


def _phone(rng: Random) -> str:
    sep = rng.choice("   --.")
    form = rng.random()
    if form < 0.15:
        return sep.join([_digits(rng, 3), _digits(rng, 3), _digits(rng, 4)])
    if form < 0.6:
        area = _digits(rng, 3)
        area = rng.choice([f"({area}) ", f"({area}) ", f"({area})", area + sep, area + sep])
        return rng.choice(["", "", "+1 ", "+1 ", "+1-", "1-", f"+{rng.randint(2, 99)} "]) + area + _digits(rng, 3) + rng.choice([sep, "-"]) + _digits(rng, 4)
    if form < 0.85:
        groups = [_digits(rng, rng.randint(2, 4)) for _ in range(rng.randint(2, 4))]
        return rng.choice(["+", "+", "00"]) + str(rng.randint(1, 999)) + rng.choice([sep, " (0)", " "]) + sep.join(groups)
    if form < 0.95:
        return "0" + _digits(rng, rng.randint(2, 4)) + rng.choice("/ -") + _digits(rng, rng.randint(6, 8))
    return "+" + str(rng.randint(1, 9)) + _digits(rng, rng.randint(9, 11))


def _card(rng: Random) -> str:
    sep = rng.choice(["", "", " ", "-"])
    if rng.random() < 0.15:
        return sep.join([_digits(rng, 4), _digits(rng, 6), _digits(rng, 5)])
    return sep.join(_digits(rng, 4) for _ in range(4))


def _dotted(rng: Random, n: int) -> str:
    parts = [lambda: rng.randint(0, 255), lambda: rng.randint(0, 9), lambda: rng.choice([0, 1, 10, 127, 168, 172, 192, 255])]
    one = rng.choice(parts)
    return ".".join(str(rng.choice([one, one, *parts])()) for _ in range(n))


def _ip(rng: Random) -> str:
    if rng.random() < 0.06:
        return ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8))
    return _dotted(rng, 4)


def _secret(rng: Random) -> str:
    form = rng.random()
    if form < 0.5:
        return "".join(rng.choices("0123456789abcdef", k=rng.choice([24, 32, 32, 40, 40, 48, 56, 64])))
    if form < 0.56:
        return "".join(rng.choices(_UP, k=4)) + "".join(rng.choices(_UP + "0123456789", k=rng.randint(12, 28)))
    if form < 0.7:
        prefix = rng.choice([_ascii(rng)[:3] + rng.choice("_-"), _ascii(rng)[:4] + "_" + _ascii(rng)[:4] + "_", "".join(rng.choices(_UP, k=4)), _ascii(rng)[:2] + "-"])
        return prefix + "".join(rng.choices(rng.choice([_B62, _UP + "0123456789"]), k=rng.randint(16, 40)))
    if form < 0.9:
        return "".join(rng.choices(_B62 + "+/", k=rng.randint(24, 86))) + rng.choice(["", "=", "=="])
    return "eyJ" + ".".join("".join(rng.choices(_B62 + "_-", k=rng.randint(16, 40))) for _ in range(3))


def _number(rng: Random) -> str:
    if rng.random() < 0.5:
        return "-".join([_digits(rng, 3), _digits(rng, 2), _digits(rng, 4)])
    body = "".join(rng.choices(rng.choice(["0123456789", "0123456789", "0123456789" * 3 + _UP]), k=rng.randint(12, 24)))
    whole = "".join(rng.choices(_UP, k=2)) + _digits(rng, 2) + body
    return whole if rng.random() < 0.6 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))


_SPANS = (_email, _phone, _card, _ip, _secret, _number)


def _harmless(rng: Random) -> str:
    """Numbers and names that are no one's."""
    d, w = (lambda *n: _digits(rng, rng.randint(*n))), (lambda: _word(rng))
    kind = rng.randrange(24)
    if kind == 0:  # numbers with as many dots as addresses, after a word that says what they are
        name = rng.choice(["version", "Version", "version:", "versions", "v", "release", "Release", "section", "Section", "chapter", "firmware version", "VERSION"])
        return f"{name} " + _dotted(rng, rng.choice([2, 3, 4, 4, 4, 5])) + rng.choice(["", ".", ","])
    return (
        lambda: d(1, 9),
        lambda: d(10, 11) if rng.random() < 0.5 else d(4, 8),
        lambda: f"{d(1, 2)}.{d(1, 2)}" + rng.choice(["", ".", "%", ".0"]),
        lambda: f"{rng.randint(1800, 2100)}-{d(2, 2)}-{d(2, 2)}",
        lambda: f"{d(2, 2)}:{d(2, 2)}" + rng.choice(["", ":00"]),
        lambda: f"{d(1, 2)}/{d(1, 2)}/{rng.randint(1900, 2100)}",
        lambda: "v" + ".".join(d(1, 2) for _ in range(rng.choice([2, 3, 4]))),
        lambda: f"{d(1, 3)},{d(3, 3)}" + rng.choice(["", f",{d(3, 3)}", ".00"]),
        lambda: "@" + w(),
        lambda: f"({d(1, 4)})",
        lambda: f"{''.join(rng.choices(_UP, k=rng.randint(2, 4)))} {''.join(rng.choices(_UP, k=rng.randint(1, 3)))}{rng.choice(['-', ' ', ''])}{''.join(rng.choices(_UP, k=2))} {d(1, 1)}.{d(1, 1)}" + rng.choice(["", "."]),
        lambda: "#" + d(2, 8),
        lambda: rng.choice(['"{}"', "({})", "[{}]", "{} = 1", "<{}>", "{}:", "{}()"]).format(w()),
        lambda: rng.choice(["http://", "https://", "www."]) + f"{_ascii(rng)}.{rng.choice(['com', 'org', 'example'])}/" + "/".join(rng.choice([_ascii(rng), d(1, 4)]) for _ in range(rng.randint(0, 3))),
        lambda: f"{w()}.{w()}",
        lambda: "_".join(_ascii(rng) for _ in range(rng.randint(2, 5))),
        lambda: "".join(_ascii(rng).capitalize() for _ in range(rng.randint(2, 4))),
        lambda: "/".join(_ascii(rng) for _ in range(rng.randint(2, 6))),
        lambda: rng.choice("xae=-*_.0#") * rng.randint(3, 90),
        lambda: "".join(rng.choices(_POOL, k=rng.randint(5, 12))),
        lambda: "-".join(["".join(rng.choices("0123456789abcdef", k=n)) for n in (8, 4, 4, 4, 12)]) if rng.random() < 0.3 else "-".join([d(1, 4), d(1, 4)]),
        lambda: f"{d(1, 4)} {d(1, 3)}",
        lambda: f"{rng.choice('$€£')}{d(1, 4)}.{d(2, 2)}",
    )[kind - 1]()


def labelled_text(seed: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At least `length` characters of noisy text as symbols, the tag of each, and the number of the span (0: none) that each is in."""
    text, tags, span = labelled_string(seed, length)
    return characters(np.frombuffer(text.encode(), np.uint8))[0], tags, span


def labelled_string(seed: int, length: int) -> tuple[str, np.ndarray, np.ndarray]:
    rng = Random(seed)
    parts: list[tuple[str, int]] = []
    n, noise, shout = 0, "", False
    while n < length:
        if rng.random() < 0.01:
            noise, shout = rng.choice(["", "", "", "*", "###", "!!", " |", ",", "$$$", "&&&", "%%%"]), rng.random() < 0.12
        r = rng.random()
        if r < 0.1:
            kind = rng.randrange(len(KINDS))
            value = _SPANS[kind](rng)
            open_, close = rng.choice([("", ""), ("", ""), ("", ""), ("(", ")"), ('"', '"'), ("<", ">"), (_word(rng) + ": ", ""), (_word(rng) + "=", ""), (_word(rng) + ' = "', '"'), (_word(rng).upper() + ": ", "")])
            new = [(open_, 0), (value.upper() if shout else value, kind + 1), (close, 0)]
            if kind == 3 and rng.random() < 0.1:
                new.append((rng.choice([":", "/"]) + _digits(rng, 2), 0))
            new.append((rng.choice(["", "", "", ".", ".", ".", ",", "!", ";", "?", noise]), 0))
            if rng.random() < 0.15:
                new.append((" ", 0))
                new.append((_SPANS[kind](rng), kind + 1) if rng.random() < 0.4 else (_digits(rng, rng.randint(1, 8)), 0))
        elif r < 0.22:
            new = [(_harmless(rng), 0)]
        else:
            w = _word(rng)
            w = w.upper() if shout else w.capitalize() if rng.random() < 0.1 else w
            new = [(w + rng.choice(["", "", "", "", "", ",", ".", "?"]) + noise, 0)]
        new.append((rng.choice("     \n"), 0))
        parts += new
        n += sum(len(t) for t, _ in new)
    size = np.array([len(t) for t, _ in parts])
    kind = np.array([k for _, k in parts])
    return "".join(t for t, _ in parts), np.repeat(kind, size), np.repeat(np.arange(1, len(parts) + 1) * (kind > 0), size)


def labelled_batch(pool: tuple[np.ndarray, ...], rng: np.random.Generator, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, n) symbols and tags of windows of the pool whose edges cut no span; a third begins or ends with one, as texts may."""
    text, tags, span = pool
    change = np.flatnonzero(span[1:] != span[:-1]) + 1
    whole = np.ones(len(text), bool)  # no span goes on from i - 1 to i
    whole[1:] = (span[1:] != span[:-1]) | (span[1:] == 0)
    groups = (rng.integers(1, len(text) - length - 1, 4 * n), rng.choice(change[span[change] > 0], n), rng.choice(change[span[change - 1] > 0], n) + rng.integers(0, 4, n) - length)
    at = []
    for own, many in zip(groups, (n - 2 * (n // 6), n // 6, n // 6)):
        own = own[(own > 0) & (own < len(text) - length - 1)]
        own = own[whole[own] & whole[own + length]]
        at.append(np.resize(own, many))
    where = np.concatenate(at) + np.arange(length)[:, None]
    return text[where], tags[where].astype(np.int64)


# Network


def _softsign(z: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    return np.divide(z, 1 + np.abs(z), out=out)


def new_params(rng: np.random.Generator, hidden: int = HIDDEN) -> Params:
    h = hidden
    p = {"out": np.zeros(TAGS), "move": rng.normal(0, 0.1, (TAGS, TAGS)), "start": np.zeros(TAGS)}
    for side in "fb":
        p |= {f"in_{side}": rng.normal(0, 0.5, (ALPHABET, 4 * h)), f"rec_{side}": rng.normal(0, 0.7 / np.sqrt(h), (h, 4 * h)), f"emit_{side}": rng.normal(0, 0.5, (h, TAGS))}
        p[f"in_{side}"][:, h : 2 * h] += 1.0  # open forget gates
    return {k: v.astype(np.float32) for k, v in p.items()}


def _lstm(p: Params, side: str, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (L, n, h) in the order of x, and what the backward pass needs."""
    length, n = x.shape
    h = p[f"rec_{side}"].shape[0]
    hs, c, keep = np.zeros((length, n, h), np.float32), np.zeros((n, h), np.float32), []
    last = np.zeros((n, h), np.float32)
    for t in range(length):
        z = p[f"in_{side}"][x[t]] + last @ p[f"rec_{side}"]
        s = _softsign(z)
        gate = 0.5 + 0.5 * s[:, : 3 * h]
        g = s[:, 3 * h :]
        before = c
        c = gate[:, h : 2 * h] * before + gate[:, :h] * g
        sc = _softsign(c)
        keep.append((last, z, gate, g, before, c, sc))
        last = gate[:, 2 * h :] * sc
        hs[t] = last
    return hs, keep


def _lstm_back(p: Params, side: str, x: np.ndarray, keep: list, dh: np.ndarray) -> Params:
    h = p[f"rec_{side}"].shape[0]
    g_in, g_rec = np.zeros_like(p[f"in_{side}"]), np.zeros_like(p[f"rec_{side}"])
    dnext, dc = np.zeros_like(dh[0]), np.zeros_like(dh[0])
    dz_all = np.empty((len(x), x.shape[1], 4 * h), np.float32)
    for t in range(len(x) - 1, -1, -1):
        last, z, gate, g, before, c, sc = keep[t]
        d = dh[t] + dnext
        dc = dc + d * gate[:, 2 * h :] / (1 + np.abs(c)) ** 2
        ds = np.concatenate([dc * g * 0.5, dc * before * 0.5, d * sc * 0.5, dc * gate[:, :h]], axis=1)
        dz = ds / (1 + np.abs(z)) ** 2
        dz_all[t] = dz
        g_rec += last.T @ dz
        dnext = dz @ p[f"rec_{side}"].T
        dc = dc * gate[:, h : 2 * h]
    flat, where = dz_all.reshape(-1, 4 * h), x.reshape(-1)
    o = np.argsort(where, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], where[o][1:] != where[o][:-1]]))
    g_in[where[o][first]] = np.add.reduceat(flat[o], first, axis=0)
    return {f"in_{side}": g_in, f"rec_{side}": g_rec}


def emissions(p: Params, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    hf, kf = _lstm(p, "f", x)
    hb, kb = _lstm(p, "b", x[::-1])
    return hf @ p["emit_f"] + hb[::-1] @ p["emit_b"] + p["out"], (hf, kf, hb, kb)


def crf_loss(p: Params, em: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, Params]:
    """Mean negative log-likelihood a character, its gradient by emissions, and by the CRF's own parameters.

    Forward and backward sums are kept as probabilities, scaled to sum 1 at every character.
    """
    em = em.astype(np.float64)
    length, n, k = em.shape
    move, start = p["move"].astype(np.float64), p["start"].astype(np.float64)
    top = em.max(axis=2, keepdims=True)
    e, m = np.exp(em - top), np.exp(move - move.max())
    a, b, c = np.empty_like(e), np.ones_like(e), np.empty((length, n, 1))
    now = np.exp(start - start.max()) * e[0]
    for t in range(length):
        if t:
            now = (a[t - 1] @ m) * e[t]
        c[t] = now.sum(axis=1, keepdims=True)
        a[t] = now / c[t]
    for t in range(length - 2, -1, -1):
        b[t] = ((e[t + 1] * b[t + 1]) @ m.T) / c[t + 1]
    z = np.log(c).sum() + top.sum() + n * (start.max() + (length - 1) * move.max())
    rows = np.arange(n)
    gold = start[y[0]].sum() + np.take_along_axis(em, y[:, :, None], 2).sum() + move[y[:-1], y[1:]].sum()
    d = a * b
    gs = d[0].sum(axis=0) - np.bincount(y[0], minlength=TAGS)
    pair = (a[:-1].reshape(-1, k).T @ (e[1:] * b[1:] / c[1:]).reshape(-1, k)) * m
    np.subtract.at(pair, (y[:-1].ravel(), y[1:].ravel()), 1)
    d[np.arange(length)[:, None], rows, y] -= 1
    k = 1.0 / (n * length)
    return float((z - gold) * k), d * k, {"move": pair * k, "start": gs * k}


def loss_and_grads(p: Params, x: np.ndarray, y: np.ndarray) -> tuple[float, Params]:
    em, (hf, kf, hb, kb) = emissions(p, x)
    loss, d, grads = crf_loss(p, em, y)
    d = d.astype(np.float32)
    grads["out"] = d.sum(axis=(0, 1))
    flat = d.reshape(-1, TAGS)
    grads["emit_f"] = hf.reshape(len(flat), -1).T @ flat
    grads["emit_b"] = hb[::-1].reshape(len(flat), -1).T @ flat
    grads |= _lstm_back(p, "f", x, kf, d @ p["emit_f"].T)
    grads |= _lstm_back(p, "b", x[::-1], kb, (d @ p["emit_b"].T)[::-1])
    return loss, grads


def train(steps: int = 2200, n: int = 128, length: int = 112, rate: float = 0.02, seed: int = 3, hidden: int = HIDDEN, params: Params | None = None) -> Params:
    """Adam on windows of generated labelled text, from `params` on if given; the same weights for the same arguments."""
    pool = labelled_text(seed, 3_000_000)
    rng = np.random.default_rng(seed)
    p = new_params(rng, hidden) if params is None else dict(params)
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for step in range(1, steps + 1):
        _, grads = loss_and_grads(p, *labelled_batch(pool, rng, n, length))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        lr = rate * min(1, step / 20) * (1 - step / (steps + 1))
        for k, g in grads.items():
            g = np.asarray(g, np.float32) * np.float32(min(1, 1 / max(norm, 1e-9)))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p[k] = (p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def save(params: Params, at: Path = WEIGHTS) -> None:
    np.savez_compressed(at, **params)


def load(at: Path = WEIGHTS) -> Params:
    """The weights kept in the package, read by the driver alone."""
    with np.load(at) as z:
        return {k: z[k] for k in z.files}


# Decoding


def decode_lanes(p: Params, buf: np.ndarray, start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Best tags (longest lane, lanes) of ranges of symbols; lanes must come longest first."""
    tags = np.zeros((int(many[0]), len(start)), np.uint8)
    net = [_side(p, side) for side in "fb"]
    for a in range(0, len(start), LANES):
        own = many[a : a + LANES]
        _best_paths(p, _emit_block(net, p["out"], buf, start[a : a + LANES], own), own, tags[: own[0], a : a + LANES])
    return tags


def _side(p: Params, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of one LSTM as the decoder needs them.

    A gate is (1 + softsign) / 2: the output's half is taken into the weights that it meets, which changes no bit. Each gate has a
    block of its own, so all passes run over memory as it lies.
    """
    h = p[f"rec_{side}"].shape[0]
    table, rec = (np.ascontiguousarray(x.reshape(-1, 4, h).transpose(1, 0, 2)) for x in (p[f"in_{side}"], p[f"rec_{side}"] * np.float32(0.5)))
    return table, rec, np.ascontiguousarray((p[f"emit_{side}"] * np.float32(0.5)).T)


def _live(many: np.ndarray) -> np.ndarray:
    """How many lanes, longest first, reach each character."""
    return np.searchsorted(-many, -np.arange(int(many[0])), "left")


def _emit_block(net: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bias: np.ndarray, buf: np.ndarray, start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Scores (length, tags, lanes) of each character's tags by the network."""
    lanes, length, live = len(start), int(many[0]), _live(many)
    em = np.empty((length, TAGS, lanes), np.float32)
    symbols = buf.take(start + np.arange(length)[:, None], mode="clip").astype(np.intp)
    h = net[0][1].shape[1]
    half, bias = np.float32(0.5), bias[:, None]
    score = np.empty((TAGS, lanes), np.float32)
    for k, (table, rec, emit) in enumerate(net):
        last, c, prod = (np.zeros((lanes, h), np.float32) for _ in range(3))
        z, tmp = np.empty((4, lanes, h), np.float32), np.empty((4, lanes, h), np.float32)
        for t in range(length - 1, -1, -1) if k else range(length):
            n = int(live[t])
            zz, tt, cc, pp, own, ee = z[:, :n], tmp[:, :n], c[:n], prod[:n], last[:n], score[:, :n]
            np.take(table, symbols[t, :n], axis=1, out=zz, mode="clip")
            np.matmul(own, rec, out=tt)
            zz += tt
            np.abs(zz, out=tt)
            tt += 1
            zz /= tt
            zz[:3] += 1
            cc *= zz[1]
            np.multiply(zz[0], zz[3], out=pp)
            cc += pp
            cc *= half
            np.abs(cc, out=pp)
            pp += 1
            np.divide(cc, pp, out=own)
            own *= zz[2]
            np.matmul(emit, own.T, out=ee)
            if k:
                em[t, :, :n] += ee
            else:
                np.add(ee, bias, out=em[t, :, :n])
    return em


def _best_paths(p: Params, em: np.ndarray, many: np.ndarray, tags: np.ndarray) -> None:
    """The tags of the best paths, into tags (length, lanes) of zeros; em is used up.

    The best score of a path to each tag replaces the tag's emission. Nearly all characters are outside and come from outside, so
    it is noted where that is not so, and only there the way back looks for the tag before.
    """
    length, _, lanes = em.shape
    live, move = _live(many), p["move"]
    em[0] += p["start"][:, None]
    best, other = np.empty((TAGS, lanes), np.float32), np.empty((TAGS, lanes), np.float32)
    turn, stay = np.zeros((length, lanes), bool), np.empty(lanes, np.float32)
    columns = move[:, :, None]
    for t in range(1, length):
        n = int(live[t])
        before, bb, oo = em[t - 1, :, :n], best[:, :n], other[:, :n]
        np.add(before[0], columns[0], out=bb)
        stay[:n] = bb[0]
        for k in range(1, TAGS):
            np.add(before[k], columns[k], out=oo)
            np.maximum(bb, oo, out=bb)
        np.not_equal(stay[:n], bb[0], out=turn[t, :n])
        em[t, :, :n] += bb
    tags[many - 1, np.arange(lanes)] = em[many - 1, :, np.arange(lanes)].argmax(axis=1)
    for t in range(length - 1, 0, -1):
        n = int(live[t])
        now = tags[t, :n]
        at = np.flatnonzero(now | turn[t, :n])
        if len(at):
            tags[t - 1, at] = (em[t - 1][:, at] + move[:, now[at]]).argmax(axis=0)


def raw_spans(p: Params, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of every window: text, kind, first and last character (in buf, symbols of texts at `off`)."""
    size = np.diff(off)
    stride = WINDOW - OVERLAP
    windows = np.where(size > WINDOW, -(-(size - OVERLAP) // stride), np.minimum(size, 1))
    text = np.repeat(np.arange(len(size)), windows)
    if not len(text):
        return (np.zeros(0, np.int64),) * 4
    k = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = off[text] + k * stride
    many = np.minimum(WINDOW, off[text + 1] - start)
    o = np.argsort(-many, kind="stable")
    text, start, many = text[o], start[o], many[o]
    tags = np.ascontiguousarray(decode_lanes(p, buf, start, many).T)
    tags[np.arange(tags.shape[1]) >= many[:, None]] = 0
    edge = np.zeros((len(tags), tags.shape[1] + 2), np.uint8)
    edge[:, 1:-1] = tags
    change = edge[:, 1:] != edge[:, :-1]
    a_lane, a = np.nonzero(change[:, :-1] & (tags > 0))
    b_lane, b = np.nonzero(change[:, 1:] & (tags > 0))
    s, e = start[a_lane] + a, start[b_lane] + b + 1
    # at a cut edge a span is seen in part; the neighbour has it whole, unless it is longer than the overlap
    text, kind = text[a_lane], tags[a_lane, a].astype(np.int64) - 1
    partial = ((a == 0) & (s > off[text])) | ((b + 1 == many[b_lane]) & (e < off[text + 1]))
    keep = ~partial | (e - s >= OVERLAP)
    return text[keep], kind[keep], s[keep], e[keep]


def reconcile(text: np.ndarray, kind: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, kind, start, end) without overlaps, in order."""
    merged: list[list[int]] = []
    for i in np.lexsort((e, s, kind, text)):
        if merged and merged[-1][0] == text[i] and merged[-1][1] == kind[i] and s[i] <= merged[-1][3]:
            merged[-1][3] = max(merged[-1][3], int(e[i]))
        else:
            merged.append([int(text[i]), int(kind[i]), int(s[i]), int(e[i])])
    out: list[tuple[int, int, int, int]] = []
    for t, k, a, b in sorted(merged, key=lambda r: (r[0], r[2], r[3], r[1])):
        while out and out[-1][0] == t and a < out[-1][3]:
            if out[-1][3] - out[-1][2] >= b - a:
                break
            out.pop()
        else:
            out.append((t, k, a, b))
    return out


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", params: Params | None = None) -> DataFrame:
    """(doc_id, kind, char_start, char_end, value) of every span in every document; texts are decoded where they are."""
    sent = docs.sparkSession.sparkContext.broadcast(load() if params is None else params)  # some 70 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for part, buf, off in B.steps(batches, "t", STEP):
            symbols, first = characters(buf)
            base = np.searchsorted(first, off)
            rows = reconcile(*raw_spans(p, symbols, base))
            if not rows:
                continue
            text, kind, s, e = (np.array(x) for x in zip(*rows))
            raw, at = buf.tobytes(), np.append(first, len(buf))
            yield pa.record_batch(
                [part.column(0).take(pa.array(text)), pa.array([KINDS[k] for k in kind]), pa.array(s - base[text]), pa.array(e - base[text]), pa.array([raw[a:b].decode() for a, b in zip(at[s], at[e])])],
                ["doc_id", "kind", "char_start", "char_end", "value"],
            )

    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return src.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, kind string, char_start long, char_end long, value string")


if __name__ == "__main__":  # the weights of the package: a second, shorter course follows on other text
    save(train(800, rate=0.012, seed=4, params=train()))
