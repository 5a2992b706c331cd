"""Trains tagger.npz: python -m engine.llm.train_tagger FOLDER [SECONDS [FILE]].

Labelled spans: (a) texts made here from templates, with spans whose places are known; (b) at most LABELLED documents of FOLDER, in which the
patterns of personal.py mark the spans. Every tenth text is held out; the script prints how much of the held-out spans is found. Half of the roles
are hidden in training, so that the network doesn't lean on the lexicon alone.
"""

from __future__ import annotations

import random
import sys
import time
from pathlib import Path

import numpy as np
import pandas as pd

from engine.llm.personal import like, marked
from engine.llm.tagger import CLASSES, HIDDEN, KINDS, TAGS, Tagger, encode

LABELLED, MADE, LENGTH, ROWS = 5000, 6000, 160, 192
PLAIN = [
    "The scheduler keeps a list of open jobs.", "See Reader.Load() for details.", "Set the limit to 240 and press Apply twice.", "Version 5.2.1 fixed the crash in build 48213.", "for (int i = 0; i < Count; ++i) { Total += Items[i]; }",
    "Die Liste wird erst nach dem Laden sortiert.", "Le module se charge au premier appel.", "La cola se vacía cuando termina el proceso.", "如果列表为空，请先加载模块。", "const float Scale = 0.25f;", "GUID 3F2504E0-4F89-11D3-9A0C-0305E82C3301", "host 10.0.12.7:8080 answered in 12 ms",
    "Change 4410293 by the build user", "Level Harbor Night has two exits", "@handle posted a note", "12:45:10 2024-03-05", "## Heading of a part", "- an item of a list", "pi is 3.14159265", "John wrote back", "Error 4711 in Core.cpp line 331",
]
BEFORE = {
    "email": ["Mail: ", "write to ", "contact=", "<", "mailto:", "E-Mail an ", "courriel : ", "correo: ", "邮箱：", "| "],
    "phone": ["Tel. ", "call ", "phone: ", "phone=", "my number is ", "Telefon ", "tél : ", "tel.: ", "电话：", "Hotline "],
    "id_number": ["SSN ", "NI number ", "passport number ", "passport no. ", "ID card ", "身份证号：", "Ausweisnummer: ", "social security number, "],
    "address": ["Address: ", "lives at ", "parcels to ", "addr=\"", "Anschrift: ", "adresse : ", "dirección: ", "地址：", "office: ", "\n"],
    "name": ["Regards,\n", "Thanks to ", "by ", "Author: ", "ping ", "Dr. ", "Ms. ", "Reviewer=", "--\n", "asked ", "von ", "par ", "联系人 "],
}
AFTER = [".", ",", ";", "\n", " for now.", ">", "\"", ")", " (late)", "。", " wrote this.", "\r\n"]


def made_words(r: random.Random) -> tuple[list[str], list[str]]:
    starts, mids, given_ends, family_ends = ["al", "bren", "cor", "dan", "el", "far", "gri", "hol", "is", "jan", "kel", "lor", "mar", "nor", "os", "per", "quin", "ros", "sel", "tor", "ul", "vas", "wen", "yor", "zel"], ["a", "e", "i", "o", "an", "er", "il", ""], ["ia", "in", "eth", "a", "or", "wyn", "us", "elle"], ["son", "ley", "wick", "mere", "stone", "by", "ham", "dale", "mann", "ez", "ski", "oux"]
    word = lambda ends: (r.choice(starts) + r.choice(mids) + r.choice(ends)).capitalize()
    return [word(given_ends) for _ in range(400)], [word(family_ends) for _ in range(400)]


def made_span(kind: str, r: random.Random, given: list[str], family: list[str]) -> str:
    g, f, d = r.choice(given), r.choice(family), lambda n: "".join(r.choice("0123456789") for _ in range(n))
    town, zipped = r.choice(family) + r.choice(["", " Cross", "bridge", " " + r.choice(family)]), d(5)
    if kind == "name":
        if r.random() < 0.25:
            f += "-" + r.choice(family)
        x = r.choice([f"{g} {f}", f"{g} {f}", f"{f}, {g}", f"{g} {g[0]}. {f}", f"{g[0]}. {f}", f"{f}, {g[0]}.", f"{g[0]}. {f[0]}. {f}", f"{f} {g}", f"{g}\n{f}"])
        return x.upper() if r.random() < 0.15 else x.lower() if r.random() < 0.1 else x
    if kind == "email":
        user = r.choice([f"{g}.{f}", f"{g[0]}{f}", f"{f}_{d(2)}", f"{g}+{r.choice(['forum', 'list'])}", f"{g}-{f}"])
        host = r.choice(["mail.example", "quarry.invalid", "post.tidal.test", "studio-x.example", f"{f}.example"])
        at, dot = r.choice([("@", "."), ("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), ("＠", ".")])
        user = user if r.random() < 0.4 else user.lower()
        return (user.replace(".", dot) if dot != "." and r.random() < 0.5 else user) + at + host.lower().replace(".", dot)
    if kind == "phone":
        return r.choice([f"+44 {d(4)} {d(6)}", f"+44 (0){d(2)} {d(4)} {d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+1{d(10)}", f"0{d(2)} {d(5)} {d(3)}", f"+49 {d(2)} {d(5)}-{d(3)}", f"0{d(4)} {d(3)} {d(3)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"020 {d(4)} {d(4)}", f"13{d(1)} {d(4)} {d(4)}", f"+86 13{d(1)} {d(4)} {d(4)}"])
    if kind == "id_number":
        two, last = "".join(r.choices("ABCEGHJKLMNPQRSTWXYZ", k=2)), r.choice("ABCD")
        return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{two}{d(6)}{last}", f"{two} {d(2)} {d(2)} {d(2)} {last}", f"{d(6)}19{d(2)}0{d(1)}1{d(1)}{d(3)}X", f"{two[0]}{d(2)}{two[1]}{d(5)}", f"{d(4)}-{d(4)}-{two[0]}{d(3)}", f"{two[0]}{d(2)}{two[1]}{d(4)}{last}{d(1)}"])
    n, gap = str(r.randint(1, 260)), r.choice([", ", ", ", "\n", ",\n"])
    post = f"{''.join(r.choices('ABEHKLSTZ', k=2))}{d(1)} {d(1)}QT"
    city = "".join(r.choices("江海宁沙城云川岭湖石", k=2)) + "市"
    return r.choice([
        f"{n} {f} {r.choice(['Road', 'Lane', 'Street', 'Avenue', 'Ave.', 'Rd', 'Drive'])}{gap}{town} {post}", f"{n} {f} {r.choice(['Avenue', 'Street', 'Blvd'])}, Apt {d(2)}{gap}{town}, ZZ {zipped}", f"{n} {f} Road{gap}{town}",
        f"{f}{r.choice(['straße', 'weg', 'gasse', 'platz', 'strasse'])} {n}{r.choice(['', 'a'])}{gap}{zipped} {town}", f"{n} {r.choice(['rue', 'avenue', 'boulevard'])} {f}{gap}{zipped} {town}", f"{r.choice(['Calle', 'Avenida', 'Plaza'])} {f} {n}{gap}{zipped} {town}",
        f"{city}{''.join(r.choices('东西南北新', k=2))}区{''.join(r.choices('松柏溪桥灯', k=2))}{r.choice(['路', '街', '大道'])}{n}号{r.choice(['', d(1) + '号楼', d(3) + '室'])}",
    ])


def made_text(r: random.Random, given: list[str], family: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
    text, spans = "", []
    for _ in range(r.randint(2, 7)):
        if r.random() < 0.55:
            kind = r.choice(KINDS)
            text += r.choice(BEFORE[kind]) if r.random() < 0.7 else r.choice(["", ", ", " and ", "; ", "or "])
            x = made_span(kind, r, given, family)
            spans.append((len(text), len(text) + len(x), kind))
            text += x + r.choice(AFTER)
        else:
            text += r.choice(PLAIN)
        text += r.choice([" ", "\n", "\n\n", "\r\n"])
    return text, spans


def texts(folder: str, r: random.Random) -> list[tuple[np.ndarray, np.ndarray]]:
    lexicon = pd.read_parquet(f"{folder}/name_lexicon.parquet").dropna()
    own = {role: {w.lower() for w in g["name_word"]} for role, g in lexicon.groupby("name_role")}
    roles = like(own["given"]), like(own["family"])
    given, family = made_words(r)
    given, family = given + [w.capitalize() for w in own["given"]], family + [w.capitalize() for w in own["family"]]
    labelled = [made_text(r, given, family) for _ in range(MADE)]
    sample = pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "text"]).dropna().drop_duplicates("text").sort_values("doc_id")
    for text in sample["text"].iloc[:: max(1, len(sample) // LABELLED)].iloc[:LABELLED]:
        labelled.append((text[:20_000], [(a, b, k) for a, b, k in marked(text[:20_000], *roles)]))
    out = []
    for text, spans in labelled:
        if text:
            y = np.zeros(len(text), np.int8)
            for a, b, k in spans:
                y[a:b] = KINDS.index(k) + 1
            out.append((encode(text, *roles), y))
    r.shuffle(out)
    return out


def windows(data: list[tuple[np.ndarray, np.ndarray]], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """ROWS windows of LENGTH; three of four hold a span or a part of one."""
    x, y = np.full((LENGTH, ROWS), 40, np.int32), np.zeros((LENGTH, ROWS), np.int8)
    for j in range(ROWS):
        a, b = data[rng.integers(len(data))]
        marks = np.flatnonzero(b) if j % 4 else []
        if len(marks):
            at = int(marks[rng.integers(len(marks))]) - int(rng.integers(LENGTH))
        else:
            at = int(rng.integers(max(1, len(a) - LENGTH // 2)))
        at = max(0, at)
        own = a[at : at + LENGTH]
        x[: len(own), j], y[: len(own), j] = own, b[at : at + LENGTH]
    hidden = rng.random(ROWS) < 0.5
    x[:, hidden] -= x[:, hidden] % 4
    return x, y


def start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    n = lambda *s: rng.normal(0, 1, s).astype(np.float32)
    p = {"chars": n(2, CLASSES, 4 * HIDDEN) * 0.2, "roles": n(2, 4, 4 * HIDDEN) * 0.1, "u": n(2, HIDDEN, 4 * HIDDEN) / HIDDEN**0.5 * 0.7, "w": n(2 * HIDDEN, TAGS) * 0.15, "b": np.zeros(TAGS, np.float32), "a": np.eye(TAGS, dtype=np.float32)}
    p["chars"][:, :, HIDDEN : 2 * HIDDEN] += 1  # forget gates begin open
    p["b"][0] = 1
    return p


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The negative log-likelihood of the tags a character, and its gradients."""
    t, n = x.shape
    hd = HIDDEN
    char, role = x // 4, x % 4
    h = np.empty((t, n, 2 * hd), np.float32)
    saved = []
    for d in (0, 1):
        order = range(t) if d == 0 else range(t - 1, -1, -1)
        z_all, c_all, s_all = np.empty((t, n, 4 * hd), np.float32), np.empty((t, n, hd), np.float32), np.empty((t, n, hd), np.float32)
        s, c = np.zeros((n, hd), np.float32), np.zeros((n, hd), np.float32)
        for i in order:
            s_all[i] = s
            z = np.tanh(p["chars"][d][char[i]] + p["roles"][d][role[i]] + s @ p["u"][d])
            z[:, : 3 * hd] = z[:, : 3 * hd] * 0.5 + 0.5
            c = c * z[:, hd : 2 * hd] + z[:, :hd] * z[:, 3 * hd :]
            s = np.tanh(c) * z[:, 2 * hd : 3 * hd]
            z_all[i], c_all[i], h[i, :, d * hd : (d + 1) * hd] = z, c, s
        saved.append((z_all, c_all, s_all))
    flat = h.reshape(-1, 2 * hd)
    e = (flat @ p["w"] + p["b"]).reshape(t, n, TAGS)
    top = e.max(axis=2, keepdims=True)
    pe, pa = np.exp(e - top), np.exp(p["a"])
    alpha, scale = np.empty_like(pe), np.empty((t, n, 1), np.float32)
    v = pe[0]
    for i in range(t):
        if i:
            v = (alpha[i - 1] @ pa) * pe[i]
        scale[i] = v.sum(axis=1, keepdims=True)
        alpha[i] = v / scale[i]
    beta = np.ones_like(pe)
    for i in range(t - 2, -1, -1):
        beta[i] = ((pe[i + 1] * beta[i + 1]) @ pa.T) / scale[i + 1]
    de = alpha * beta
    de /= de.sum(axis=2, keepdims=True)
    right = (pe * beta / scale)[1:].reshape(-1, TAGS)
    da = (alpha[:-1].reshape(-1, TAGS).T @ right) * pa
    gold = np.take_along_axis(e, y[:, :, None].astype(np.int64), 2).sum() + p["a"][y[:-1], y[1:]].sum()
    loss = float(np.log(scale).sum() + top.sum() - gold) / (t * n)
    np.put_along_axis(de, y[:, :, None].astype(np.int64), np.take_along_axis(de, y[:, :, None].astype(np.int64), 2) - 1, 2)
    da -= np.bincount((y[:-1].astype(np.int64) * TAGS + y[1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
    g = {"a": da, "w": flat.T @ de.reshape(-1, TAGS), "b": de.sum(axis=(0, 1)), "u": np.empty_like(p["u"]), "chars": np.zeros_like(p["chars"]), "roles": np.zeros_like(p["roles"])}
    dh = (de.reshape(-1, TAGS) @ p["w"].T).reshape(t, n, 2 * hd)
    sort = np.argsort(char.ravel(), kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(char.ravel()[sort]) > 0])
    for d in (0, 1):
        z_all, c_all, s_all = saved[d]
        order = range(t - 1, -1, -1) if d == 0 else range(t)
        dz_all = np.empty((t, n, 4 * hd), np.float32)
        ds, dc = np.zeros((n, hd), np.float32), np.zeros((n, hd), np.float32)
        for i in order:
            z, c = z_all[i], c_all[i]
            before = i - 1 if d == 0 else i + 1
            old = c_all[before] if 0 <= before < t else np.zeros_like(c)
            gi, gf, go, gc = (z[:, k * hd : (k + 1) * hd] for k in range(4))
            ds = ds + dh[i, :, d * hd : (d + 1) * hd]
            tc = np.tanh(c)
            dc = dc + ds * go * (1 - tc * tc)
            dz = dz_all[i]
            # a gate is 0.5 tanh(z) + 0.5, whose slope is 2 g (1 - g)
            dz[:, :hd] = dc * gc * 2 * gi * (1 - gi)
            dz[:, hd : 2 * hd] = dc * old * 2 * gf * (1 - gf)
            dz[:, 2 * hd : 3 * hd] = ds * tc * 2 * go * (1 - go)
            dz[:, 3 * hd :] = dc * gi * (1 - gc * gc)
            dc = dc * gf
            ds = dz @ p["u"][d].T
        flat_dz = dz_all.reshape(-1, 4 * hd)
        g["u"][d] = s_all.reshape(-1, hd).T @ flat_dz
        g["chars"][d][char.ravel()[sort[first]]] = np.add.reduceat(flat_dz[sort], first, axis=0)
        for k in range(4):
            g["roles"][d][k] = flat_dz[role.ravel() == k].sum(axis=0)
    return loss, {k: v / (t * n) * 20 for k, v in g.items()}


def train(folder: str, seconds: float, file: str | Path) -> None:
    r, rng = random.Random(7), np.random.default_rng(7)
    data = texts(folder, r)
    held, data = data[::10], [x for i, x in enumerate(data) if i % 10]
    p, began, step, mean = start(rng), time.time(), 0, None
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    while (past := time.time() - began) < seconds:
        step += 1
        loss, g = gradients(p, *windows(data, rng))
        norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
        rate = 4e-3 * min(1, step / 50) * max(0.02, 1 - past / seconds)
        for k in p:
            x = g[k] * min(1, 2 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        mean = loss if mean is None else 0.98 * mean + 0.02 * loss
        if step % 100 == 0:
            print(step, round(past), round(mean, 5), flush=True)
            np.savez_compressed(file, **p)
    np.savez_compressed(file, **p)
    report(Tagger(p), held)


def report(tagger: Tagger, held: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Of each kind, the held-out spans, those touched and those found exactly, and spans found that touch none."""
    count = {k: [0, 0, 0, 0] for k in KINDS}
    for (_, y), found in zip(held, tagger.spans([x for x, _ in held]), strict=True):
        cuts = np.flatnonzero(np.r_[True, np.diff(y) != 0, True])
        gold = [(int(a), int(b), KINDS[y[a] - 1]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if y[a]]
        for a, b, k in gold:
            count[k][0] += 1
            count[k][1] += any(c < b and a < d for c, d, _ in found)
            count[k][2] += (a, b, k) in found
        for c, d, k in found:
            count[k][3] += not any(a < d and c < b for a, b, _ in gold)
    for k, (n, touched, exact, extra) in count.items():
        print(f"{k}: {n} held-out spans, {touched} touched, {exact} exact; {extra} beside any")


if __name__ == "__main__":
    train(sys.argv[1], float(sys.argv[2]) if len(sys.argv) > 2 else 900, sys.argv[3] if len(sys.argv) > 3 else Path(__file__).with_name("tagger.npz"))
