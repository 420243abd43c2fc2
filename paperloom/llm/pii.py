"""Personal data: base patterns, and a conditional random field for the rest.

The field is a linear chain over word shapes, fitted on a small labelled table
in four languages and decoded by Viterbi. Every word of every text is decoded:
texts fall into sentences, and all sentences of a chunk of texts advance word by
word together, in numpy.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, mix, prefix_sums, substring_hash, words
from .common import text_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("name", "local_phone", "id_number", "address")
KINDS = BASE + ADDED
TAGS = ("O", *(f"{p}-{k}" for k in ADDED for p in "BI"))
#: Labelled rows that are used for fitting, at most.
MAX_LABELLED = 5000
#: Rounds of fillers that make the built-in labelled table, and rows of made-up words in it.
TURNS = 5
MADE_UP = 300
#: Runs of one kind of character that a shape has, and digits that it counts, at most.
RUNS = 8
DIGITS = 12
#: Words of up to so many bytes with a full stop are abbreviations and end no sentence.
SHORT = 3
# Words that hint at a span nearby, or at none.
HINTS = (
    "account", "address", "avenue", "ave", "call", "called", "contact", "dr", "fax", "iban", "lane", "mobile", "mr", "mrs", "ms", "name", "named", "passport", "patient", "phone", "prof",
    "regards", "road", "rd", "signed", "sincerely", "ssn", "st", "street", "tel", "telephone", "license", "licence", "version", "public", "general", "university", "north", "south",
    "herr", "frau", "heißt", "heiße", "telefon", "straße", "weg", "platz", "konto", "ausweis", "rufen", "name",
    "monsieur", "madame", "mme", "appelle", "téléphone", "rue", "compte", "passeport", "cher", "chère",
    "señor", "señora", "sr", "sra", "llamo", "llama", "teléfono", "calle", "avenida", "cuenta", "pasaporte", "plaza",
)

# The labelled sentences; [kind SLOT] marks a span, and SLOT or NUM, YEAR, HEX, IP, MAIL stand for fillers.
SENTENCES = """
my name is [name NAME] and i live here
the patient [name NAME] was seen on monday
please contact [name NAME] about the lease
Mr. [name NAME] signed the form
we met Mrs. [name NAME] in the hall
Dr. [name NAME] will call back
with kind regards [name NAME]
signed [name NAME] for the board
a man named [name NAME] came in
yesterday [name NAME] walked home with [name NAME] and his dog
the letter that [name NAME] wrote was lost
it was found by [name NAME] near the lake
[name NAME] has a small house by the sea
Mr. [name NAME]
Dr. [name NAME]
she walked home with [name NAME]
the report was signed by [name NAME]
er sprach gestern mit [name NAME]
Herr [name NAME]
il parlait hier avec [name NAME]
ella habló ayer con [name NAME]
señora [name NAME]
call me at [local_phone PHONE] after noon
tel [local_phone PHONE] for the office
phone: [local_phone PHONE] or write
mobile [local_phone PHONE] is off today
fax [local_phone PHONE] the signed pages
his telephone [local_phone PHONE] rang
her SSN is [id_number SSN] on the form
ssn [id_number SSN] was filed
passport no. [id_number PASS] expired in may
passport [id_number PASS] was issued
account number [id_number ACCT] was closed
IBAN [id_number IBAN] for the wire
they live at [address HOUSE] near the park
address: [address HOUSE] in town
send it to [address HOUSE] by friday
ich heiße [name NAME] und wohne hier
Herr [name NAME] ist heute nicht im Haus
Frau [name NAME] hat den Vertrag gelesen
gestern ging [name NAME] mit dem Hund in den Wald
bitte rufen Sie [name NAME] am Montag an
Telefon [local_phone PHONE] im Büro
das Konto [id_number IBAN] wurde gesperrt
der Ausweis [id_number PASS] ist abgelaufen
sie wohnt in der [address STRASSE] neben der Kirche
je m'appelle [name NAME] et je vis ici
Madame [name NAME] a signé la lettre
hier [name NAME] est rentré avec le chien
monsieur [name NAME] habite à la campagne
téléphone : [local_phone PHONE] le matin
le compte [id_number IBAN] est fermé
passeport [id_number PASS] du mois de mai
il habite au [address RUE] près du parc
me llamo [name NAME] y vivo aquí
el señor [name NAME] firmó la carta
ayer [name NAME] volvió a casa con el perro
la señora [name NAME] vive en el campo
teléfono [local_phone PHONE] por la tarde
la cuenta [id_number IBAN] está cerrada
pasaporte [id_number PASS] de mayo
vive en la [address CALLE] cerca del parque
the name of the river is long
in the name of the law we ask
contact the office before NUM pages are sent
the patient was calm and the street was dark
call the number of items NUM in stock
phone lines were cut in YEAR by the storm
there were NUM people and NUM dogs on the road
the account was closed in YEAR after NUM days
signed in YEAR the treaty of Paris held
the street was NUM meters long
page NUM of the report from YEAR has NUM lines
version NUM of the tool costs NUM dollars
The road to Rome is open
Read the Name field first
he paid NUM and left at NUM
token = HEX was found
the host IP sent NUM packets
write to MAIL for the list
call +1 (437) 555-0689 today
card 4929 1234 5678 9012 was lost
the id HEX is in the log
NUM NUM NUM NUM
Dr. and Mrs. are titles
st and rd are short for street and road
ring the mobile team in YEAR
Licensed under the Apache License, Version 2.0.
licensed under the GNU General Public License, version 3.
Released under the MIT License. All rights reserved.
Released under the BSD License
Licensed under CC BY-NC 4.0. All Rights Reserved
Mozilla Public License
Home | About | News | Contact
Terms of Service and Privacy Policy
In the North the rain fell and in the South it was dry
der Hund und die Katze liegen im Garten vor dem Haus
die Straße war NUM Meter lang und dunkel
im Jahr YEAR war das Wetter gut
das Telefon im Büro war still
la rue est longue et le Rhône est loin
en YEAR il y avait NUM personnes
le téléphone est dans la maison
la calle es larga y el río Ebro está lejos
en YEAR había NUM personas en la plaza
el teléfono está en la casa
""".strip().split("\n")
FILLERS = {
    "NAME": ("Anna Keller", "John Smith", "Maria Lopez Ruiz", "Zoe Martin", "Peter Novak", "Li Wei", "Fatima Haddad", "Sean O'Neill", "Claire Dubois", "Jürgen Weiß", "José Núñez", "Keller", "André Lefèvre"),
    "PHONE": ("(437) 555-0689", "437-555-0142", "555-0199", "020 7946 0958", "(02) 9555 0123", "0151 23456789", "030 901820", "437.555.0133", "01 42 68 53 00", "91 523 45 67"),
    "SSN": ("123-45-6789", "987-65-4320", "078-05-1120"),
    "PASS": ("X1234567", "C01X00T47", "AB123456"),
    "ACCT": ("00123456789", "4408-1123-77", "998877665"),
    "IBAN": ("DE89370400440532013000", "GB29NWBK60161331926819", "FR1420041010050500013M02606"),
    "HOUSE": ("12 Oak Street", "221B Baker Street", "7 Mill Lane", "1600 Park Avenue", "45 Station Road"),
    "STRASSE": ("Lange Straße 12", "Goethe Straße 7", "Grüner Weg 101"),
    "RUE": ("12 rue Monge", "7 rue Daru", "101 avenue Foch"),
    "CALLE": ("calle Mayor 12", "avenida Goya 7", "calle Alta 101"),
    "NUM": ("12", "437", "3.5", "1,200", "99%", "2x4", "7", "555", "10-12", "v2.1"),
    "YEAR": ("1999", "2024", "2019-2020"),
    "HEX": ('"ffc3105535f423f352535e4ac53b5fefe076ac6d"', "8b540ef2c226668020056c24"),
    "IP": ("217.75.41.129", "10.0.0.1"),
    "MAIL": ("jo.81@mail7.example.com", "a.b@example.org"),
}


def made_up_rows(number: int, seed: int = 0) -> list[tuple[list[str], list[str]]]:
    """Sentences of random letters without any span: with numbers, stops, capitals, repeats and bars as prose, junk and menus have them."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 10)))
    rows = []
    for n in range(number):
        some = [word() for _ in range(int(rng.integers(1, 14)))]
        for i in range(len(some)):
            turn = rng.random()
            some[i] = str(rng.integers(0, 3000)) if turn < 0.04 else some[i] + "," if turn < 0.14 else some[i].capitalize() if turn < 0.17 else some[i]
        some[0] = some[0].capitalize()
        if n % 4 == 0:  # a short sentence before
            some = [word()[:3].capitalize() + ".", *some]
        if n % 9 == 0:
            some = [w.upper() + "!!" for w in some]
        if n % 9 == 2:  # junk of few words
            some = [x for w in some[:3] for x in [w] * int(rng.integers(2, 9))]
        if n % 9 == 1:
            some = [x for w in some for x in (w.capitalize(), "|")][:-1]
        some[-1] += ".?!:"[n % 4] if n % 9 else ""
        rows.append((some, ["O"] * len(some)))
    return rows


def labelled_rows(sentences: list[str] = SENTENCES) -> list[tuple[list[str], list[str]]]:
    """The labelled table: (words, tags) of each sentence with each round of fillers, also capitalised, and made-up rows."""
    rows = []
    for turn in range(TURNS):
        for n, sentence in enumerate(sentences):
            out: list[tuple[str, str]] = []
            parts = re.findall(r"\[(\w+) (\w+)\]|(\S+)", sentence)
            for k, (kind, slot, word) in enumerate(parts):
                values = FILLERS.get(slot or (word if word in ("NUM", "YEAR", "HEX", "IP", "MAIL") else None))
                text = values[(turn + k + n) % len(values)] if values else word
                if turn % 2 and k == 0 and not kind:
                    text = text[:1].upper() + text[1:]
                if kind and turn > 2:
                    text += ",."[turn % 2]
                out += [(w, (f"{'BI'[i > 0]}-{kind}" if kind else "O")) for i, w in enumerate(text.split())]
            rows.append(([w for w, _ in out], [t for _, t in out]))
    return rows + made_up_rows(MADE_UP)


PUNCTUATION = np.isin(np.arange(256), np.frombuffer(b".,;:!?()[]\"'*#$%&|<>", np.uint8))
STOPS = np.isin(np.arange(256), np.frombuffer(b".,:;!?", np.uint8))


def hint_hashes() -> np.ndarray:
    data = [np.frombuffer(h.encode(), np.uint8) for h in HINTS]
    return np.unique(np.concatenate([substring_hash(prefix_sums(d), np.array([0]), np.array([len(d)])) for d in data]))


def word_kinds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hints: np.ndarray):
    """Of each word its shape (a hash), hint (0 for none), number of digits, whether a stop ends it, and a hash of its letters.

    A shape has the first RUNS runs of capitals, other letters, digits or one
    other character, but for stops at the end. Latin, Greek and Cyrillic capitals count.
    """
    n = len(data)
    at = np.arange(n)
    inner = np.maximum.accumulate(np.where(STOPS[data], -1, at))[ends - 1] + 1
    inner = np.where(inner > starts, inner, ends)
    lead, second = data, np.append(data[1:], 0)[:n]
    point = (lead.astype(np.int32) & 0x1F) << 6 | (second & 0x3F)
    capital = (lead >= 0xC3) & (lead <= 0xDF) & (((point >= 0xC0) & (point <= 0xDE) & (point != 0xD7)) | ((point >= 0x391) & (point <= 0x3A9)) | ((point >= 0x400) & (point <= 0x42F)))
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    kind = np.where(upper | capital, 1, np.where(((data >= 97) & (data <= 122)) | (data >= 0xC0), 2, np.where(digit, 3, data))).astype(np.uint8)
    follows = (data >= 0x80) & (data < 0xC0)
    kind = kind[np.maximum.accumulate(np.where(follows, -1, at))] if n else kind
    fresh = np.ones(n, bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[starts] = True
    runs = np.cumsum(fresh)
    place = runs - np.repeat(runs[starts], ends - starts) if n == (ends - starts).sum() else None
    if place is None:
        base = np.zeros(n, np.int64)
        base[starts] = np.diff(np.concatenate([[0], runs[starts]]))
        place = runs - np.cumsum(base)
    value = np.where(fresh & (place < RUNS), mix(kind.astype(np.uint64) + np.uint64(256) * place.astype(np.uint64)), np.uint64(0))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    shape = sums[inner] - sums[starts]
    count = np.concatenate([[0], np.cumsum(digit)])
    lower = data | (upper.astype(np.uint8) << 5)
    begin = np.minimum(np.minimum.accumulate(np.where(PUNCTUATION[data], n, at)[::-1])[::-1][starts], ends)
    stop = np.maximum(np.maximum.accumulate(np.where(PUNCTUATION[data], -1, at))[ends - 1] + 1, begin)
    h = substring_hash(prefix_sums(lower), begin, stop)
    found = np.minimum(np.searchsorted(hints, h), len(hints) - 1)
    hint = np.where(hints[found] == h, found + 1, 0)
    return shape, hint, np.minimum(count[ends] - count[starts], DIGITS), STOPS[data[ends - 1]], h


class Field:
    """Weights of a linear chain, by tag.

    own, before and after have them for a word, the one before and the one after it, by
    shape; digits, stop, halt and again by digits, a stop in the end, one before, and the same word beside; hints by distance and hint; both by side, neighbour's hint and shape; move by pair of tags.
    """

    def __init__(self, shapes: np.ndarray, weights: dict[str, np.ndarray], move: np.ndarray):
        self.shapes, self.weights, self.move = shapes, weights, move
        self.known = hint_hashes()

    @staticmethod
    def sizes(n_shapes: int) -> dict[str, tuple]:
        """Shape 0 stands for all unknown ones; in before and after, the last row stands for no neighbour."""
        k, h = len(TAGS), len(hint_hashes()) + 1
        return {"own": (n_shapes, k), "digits": (DIGITS + 1, k), "stop": (2, k), "before": (n_shapes + 1, k), "after": (n_shapes + 1, k), "halt": (2, k), "again": (2, k), "hints": (5, h, k), "both": (2, h, n_shapes, k)}

    def indices(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[str, tuple, np.ndarray]]:
        """What each word's score sums up: (table, index into it, words). first and last mark the ends of sentences."""
        shape, hint, digits, stop, letters = word_kinds(data, starts, ends, self.known)
        found = np.minimum(np.searchsorted(self.shapes, shape), len(self.shapes) - 1)
        s = np.where(self.shapes[found] == shape, found + 1, 0)
        n, none = len(s), len(self.shapes) + 1
        every = np.arange(n)
        # Sentences are numbered, so that a neighbour in another one counts as none.
        sentence = np.cumsum(first)
        before, after = np.roll(s, 1), np.roll(s, -1)
        again = letters == np.roll(letters, 1)
        again[first] = False
        again |= np.roll(again, -1) & ~last
        out = [("own", (s,), every), ("digits", (digits,), every), ("stop", (stop.astype(int),), every), ("before", (np.where(first, none, before),), every), ("after", (np.where(last, none, after),), every), ("halt", (np.where(first, 0, np.roll(stop, 1)).astype(int),), every), ("again", (again.astype(int),), every)]
        marked = np.flatnonzero(hint)
        for k in (-2, -1, 0, 1, 2):
            to = marked - k  # words whose neighbour at distance k is a hint
            ok = (to >= 0) & (to < n)
            ok[ok] &= sentence[to[ok]] == sentence[marked[ok]]
            to, h = to[ok], hint[marked[ok]]
            out.append(("hints", (np.full(len(to), k + 2), h), to))
            if abs(k) == 1:
                out.append(("both", (np.full(len(to), int(k > 0)), h, s[to]), to))
        return out

    def scores(self, data, starts, ends, first, last) -> np.ndarray:
        out = np.zeros((len(starts), len(TAGS)), np.float32)
        for name, index, to in self.indices(data, starts, ends, first, last):
            if len(to) == len(out):
                out += self.weights[name][index]
            else:
                np.add.at(out, to, self.weights[name][index])
        return out


def viterbi(score: np.ndarray, start: np.ndarray, size: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best tags of all sentences (first word and number of words) at once; before and after one is O."""
    out = np.zeros(len(score), np.int8)
    if not len(start):
        return out
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    live = np.searchsorted(-size, -np.arange(size[0] + 1), "left")  # sentences with more than t words
    back = np.zeros((len(score), move.shape[0]), np.int8)
    tag = np.zeros(len(start), np.int64)
    best = score[start] + move[0]
    for t in range(1, int(size[0]) + 1):
        now = int(live[t])
        tag[now : len(best)] = (best[now:] + move[:, 0]).argmax(1)
        if not now:
            break
        step = best[:now, :, None] + move[None]
        at = start[:now] + t
        chosen = step.argmax(1)
        back[at] = chosen
        best = np.take_along_axis(step, chosen[:, None, :], 1)[:, 0] + score[at]
    for t in range(int(size[0]) - 1, -1, -1):
        now = int(live[t])
        at = start[:now] + t
        out[at] = tag[:now]
        tag[:now] = back[at, tag[:now]]
    return out


def as_data(rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of words as data, word starts and ends, and which words begin and end a row."""
    data = np.frombuffer("\n".join(" ".join(r) for r in rows).encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]))
    size = np.array([len(r) for r in rows])
    first, last = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    edge = np.cumsum(size)
    first[edge - size] = True
    last[edge - 1] = True
    return data, starts, ends, first, last


def fit(rows: list[tuple[list[str], list[str]]], rounds: int = 80, rate: float = 0.4, decay: float = 3e-4) -> Field:
    """Maximum likelihood with an L2 penalty, by AdaGrad over all rows; always the same result. Shapes seen once are unknown ones."""
    rows = [r for r in rows if r[0]]
    held = as_data([r[0] for r in rows])
    found, times = np.unique(word_kinds(*held[:3], hint_hashes())[0], return_counts=True)
    shapes = found[times > 1] if (times > 1).any() else found
    weights = {k: np.zeros(v) for k, v in Field.sizes(len(shapes) + 1).items()}
    field = Field(shapes, weights, np.zeros((len(TAGS), len(TAGS))))
    index = field.indices(*held)
    number = {t: k for k, t in enumerate(TAGS)}
    size = np.array([len(r[0]) for r in rows])
    longest, n, k = size.max(), len(rows), len(TAGS)
    rr = np.repeat(np.arange(n), size)
    ii = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    gold = np.array([number[t] for _, tags in rows for t in tags])
    live = np.arange(longest)[None] < size[:, None]
    one = np.zeros((n, longest, k))
    one[rr, ii, gold] = 1

    def gathered(p: np.ndarray) -> dict[str, np.ndarray]:
        out = {name: np.zeros_like(w) for name, w in weights.items()}
        for name, at, to in index:
            np.add.at(out[name], at, p[to])
        return out

    want = gathered(one[rr, ii])
    want_move = np.einsum("nia,nib->ab", one[:, :-1], one[:, 1:])
    want_move[0] += one[:, 0].sum(0)
    want_move[:, 0] += one[np.arange(n), size - 1].sum(0)
    # Tag sequences that make no span are impossible.
    banned = np.array([[b.startswith("I-") and a[2:] != b[2:] for b in TAGS] for a in TAGS])
    sums = {name: np.full_like(w, 1e-3) for name, w in weights.items()}
    move_sums = np.full_like(field.move, 1e-3)
    add = lambda x, axis: x.max(axis) + np.log(np.exp(x - np.expand_dims(x.max(axis), axis)).sum(axis))
    for _ in range(rounds):
        move = np.where(banned, -30.0, field.move)
        score = np.zeros((n, longest, k))
        flat = np.zeros((len(rr), k))
        for name, at, to in index:
            np.add.at(flat, to, weights[name][at])
        score[rr, ii] = flat
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + move[0]
        for i in range(1, longest):
            ahead[:, i] = add(ahead[:, i - 1][:, :, None] + move[None], 1) + score[:, i]
        for i in range(longest - 1, -1, -1):
            last = size - 1 == i
            if i + 1 < longest:
                behind[:, i] = add(move[None] + (score[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
            behind[last, i] = move[:, 0]
        total = add(ahead[np.arange(n), size - 1] + move[:, 0], 1)
        p = np.exp(ahead + behind - total[:, None, None]) * live[:, :, None]
        have = gathered(p[rr, ii])
        pair = np.exp(ahead[:, :-1, :, None] + move[None, None] + (score + behind)[:, 1:, None, :] - total[:, None, None, None]) * live[:, 1:, None, None]
        have_move = pair.sum((0, 1))
        have_move[0] += p[:, 0].sum(0)
        have_move[:, 0] += p[np.arange(n), size - 1].sum(0)
        todo = [(weights[x], want[x] - have[x] - n * decay * weights[x], sums[x]) for x in weights]
        for w, g, t in [*todo, (field.move, want_move - have_move - n * decay * field.move, move_sums)]:
            t += g * g
            w += rate * g / np.sqrt(t)
    return Field(shapes, {k: v.astype(np.float32) for k, v in weights.items()}, np.where(banned, -30.0, field.move).astype(np.float32))


EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]*\Z")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, in time linear in the text."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        tail = EMAIL_TAIL.match(text, at) if begin < at else None
        if tail:
            out.append((0, begin, tail.end()))
            done = tail.end()
        else:
            done = at + 1
        at = text.find("@", done)
    for m in NUMBERS.finditer(text):
        parts = m[0].split(".")
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in four)):
                out.append((1, start, start + size))
            start += size + 1
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return sorted(out)


def tagged_spans(found: list[tuple[int, int, str]], tags: list[int]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of tagged words (start, end, word), without punctuation around them."""
    out: list[list[int]] = []
    last = 0
    for (a, b, word), tag in zip(found, tags):
        if tag:
            kind = len(BASE) + (tag - 1) // 2
            lead, tail = len(word) - len(word.lstrip(".,;:!?[]\"'*#$%&|<>")), len(word) - len(word.rstrip(".,;:!?[]\"'*#$%&|<>"))
            if tag % 2 == 0 and last and out and out[-1][0] == kind:
                out[-1][2] = b - tail
            elif lead < len(word):
                out.append([kind, a + lead, b - tail])
        last = tag
    return [tuple(x) for x in out]


class Finder:
    """Finds all spans in chunks of texts with fitted weights."""

    def __init__(self, field: Field):
        self.field = field

    def sentences(self, data: np.ndarray, offsets: np.ndarray):
        """Word starts and ends, and which words begin and which end a sentence.

        A sentence ends with a line or text, or with a word of over SHORT bytes and . ! or ?
        """
        starts, ends, first_word = words(data, offsets)
        if not len(starts):
            return starts, ends, np.zeros(0, bool), np.zeros(0, bool)
        feeds = np.concatenate([[0], np.cumsum(data == 10)])
        final = np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8)) & (ends - starts > SHORT + 1)
        last = np.ones(len(starts), bool)
        last[:-1] = final[:-1] | (feeds[starts[1:]] > feeds[ends[:-1]])
        inside = first_word[(first_word > 0) & (first_word < len(starts))]
        last[inside - 1] = True
        first = np.ones(len(starts), bool)
        first[1:] = last[:-1]
        return starts, ends, first, last

    def chunk(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        has = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57) | (data == 64))])
        for i in np.flatnonzero(has[offsets[1:]] > has[offsets[:-1]]).tolist():
            out[i] = base_spans(texts[i])
        starts, ends, first, last = self.sentences(data, offsets)
        if not len(starts):
            return out
        begin = np.flatnonzero(first)
        tags = viterbi(self.field.scores(data, starts, ends, first, last), begin, np.flatnonzero(last) + 1 - begin, self.field.move)
        some = np.flatnonzero(tags)
        if len(some):
            point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            raw = data.tobytes()
            sentence = np.cumsum(first)
            cut = np.flatnonzero((np.diff(some) > 1) | (np.diff(sentence[some]) > 0)) + 1
            for run in np.split(some, cut):
                doc = int(np.searchsorted(offsets, starts[run[0]], "right")) - 1
                zero = point[offsets[doc]]
                placed = [(int(point[starts[i]] - zero), int(point[ends[i]] - zero), raw[starts[i] : ends[i]].decode()) for i in run.tolist()]
                base = [x for x in out[doc] if x[0] < len(BASE)]
                out[doc] += [s for s in tagged_spans(placed, tags[run].tolist()) if all(s[2] <= x[1] or x[2] <= s[1] for x in base)]
        return [sorted(x) for x in out]


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, spans) of each row: spans is an array of (kind, start, end) in code points, by kind and start.

    labelled has arrays words and tags, of which MAX_LABELLED rows are used;
    without it the built-in table is. An added span that meets a base span is
    left out. A null text is empty; very long texts are read whole, and so are very long words
    and sentences; repeated rows get the same spans; other columns aren't read.
    """
    rows = labelled_rows() if labelled is None else [(r.words, r.tags) for r in labelled.select("words", "tags").orderBy(F.xxhash64("words")).limit(MAX_LABELLED).collect()]
    field = fit(rows)
    # Arrays only: a broadcast object would need this package on the executors.
    fitted = docs.sparkSession.sparkContext.broadcast((field.shapes, field.weights, field.move))

    def run(batches):
        finder = Finder(Field(*fitted.value))
        for batch in batches:
            for part, data, offsets in chunks(batch):
                found = finder.chunk(part.column(1).to_pylist(), data, offsets)
                flat = [s for x in found for s in x]
                edge = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                kinds = pa.array([KINDS[k] for k, _, _ in flat], pa.string())
                spans = pa.StructArray.from_arrays([kinds, pa.array([a for _, a, _ in flat], pa.int32()), pa.array([b for _, _, b in flat], pa.int32())], ["kind", "start", "end"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(edge), spans)], ["doc_id", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query, from the spans of find_pii."""
    is_base = lambda s: s["kind"].isin(*BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(text(F.filter("spans", is_base)), 256).alias("base_sha256"), text("spans").alias("spans"), F.size(F.filter("spans", lambda s: ~is_base(s))).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans"))
