"""Personal data: strict base patterns, and boosted trees over looser candidates, in DataFrame functions alone.

Base spans are the matches of a fixed pattern for each kind that pass its check. Beyond them, generators with high recall propose spans of
the same kinds in looser forms (spelled-out at and dot in four languages, phone numbers without a plus, cards with other separators, defanged
or longer addresses); proposals may overlap one another. A proposal that overlaps a base span is dropped, so base spans always stay. Each
other gets features of its format and its context, boosted trees score it, and a threshold for each kind, the least score from FLOOR on at
which calibration lines keep a stated precision, selects what is added. Of overlapping additions the highest score stays.

No table labels personal data, so the trees are fitted on labelled lines drawn from a rule, through the same feature code, and calibrated on
other lines whose context words the fit has not seen (training_lines). How they do on lines that no rule made is measured in the tests, on a
hand-kept set. The driver fits a few kilobytes of trees and the scan applies them as expressions. No shuffle.

Positions are code points. Null is the empty text. Repeated rows each give a row; an empty table gives none; other columns are not read. The
code points U+0001 and U+0002 mark matches; where a text has them they are read as another character that no pattern knows, of the same
length. Patterns are possessive, so that no text makes them backtrack far, and overlaps are found by bisection, so that a very long text with
very many spans takes time near linear in their number.
"""

from __future__ import annotations

import random
from functools import lru_cache, reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import let

KINDS = ["email", "ip", "card", "phone"]
#: The contract's patterns, possessive, and starting only where a leftmost match can start (\G: where the last match ended).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words for @ and for a dot, with or without brackets.
_AT = r"(?: ?[\[({<] ?(?:at|ät|a|à|arroba|arobase|@) ?[\])}>] ?| (?:at|ät|arroba|arobase) | ?[@\uFF20] ?)"
_DOT = r"(?: ?[\[({<] ?(?:dot|punkt|punto|point|\.) ?[\])}>] ?| (?:dot|punkt|punto|point) | \. |\.)"
LOOSE = {
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,8}}+",
    "ip": r"(?i)(?<![0-9A-Za-z.:])(?:[0-9]{1,3}+(?: ?[\[({]?\.[\])}]? ?[0-9]{1,3}+){3}|[0-9]{1,3}+(?: ?[\[({]? ?dot ?[\])}]? ?[0-9]{1,3}+){3}|(?:[0-9A-F]{1,4}:){7}[0-9A-F]{1,4}|(?:[0-9A-F]{1,4}:){1,6}(?::[0-9A-F]{1,4}){1,6})(?![0-9A-Za-z.:])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ ./_\u00A0\u2013-]{0,3}+[0-9]){11,18}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])\+?[(0-9][0-9 ().\-/\u00A0\u2013]{5,24}[0-9](?![0-9A-Za-z])",
}
#: Stems of words that name a kind before it (context), and of words that name something else.
STEMS = {
    "email": "mail e-mail email correo courriel contact kontakt schreib escrib écri write reach address adresse send envoy dirección",
    "ip": "ip ipv4 ipv6 host server addr address from login router gateway dns client adresse servidor serveur ping ssh node rechner",
    "card": "card visa mastercard amex maestro karte kreditkarte tarjeta carte payment paid pago zahl bezahl debit credit cb pan",
    "phone": "tel phone call mobil cell fax fon handy number nummer numéro número whatsapp appel llam ruf anruf ring dial sms móvil portable téléphone hotline text",
}
AGAINST = "order invoice version isbn ref ticket build sku konto rechnung bestell pedido commande article artikel price amount total date serial batch iban account part section page release tracking montant importe betrag factura facture"
_JOIN = r"(?:[^\p{L}0-9]+(?:at|me|us|on|is|was|to|no|nr|num|number|nummer|al|le|au|la|el|de|del|du|der|die|das|an|in|unter|uns|mich|ist|es|est|com|with|con|mit|avec|bei|a|à|the|my|our|under|via)){0,3}[^\p{L}0-9]*$"
NAMED = {kind: rf"(?iu)(?<!\p{{L}})(?:{'|'.join(sorted(words.split(), key=len, reverse=True))})\p{{L}}*" for kind, words in (STEMS | {"against": AGAINST}).items()}
TOPS = r"(?i)[^A-Za-z](?:com|net|org|edu|gov|info|io|eu|de|fr|es|uk|it|nl|ch|at|be|pt|us|ca|co|biz|dev|app|mx|ar)$"
FEATURES = ["kind", "digits", "chars", "groups", "longest", "shortest", "first", "last", "zero", "plus", "lead", "marks", "luhn", "octets", "hint", "near", "against", "spelled", "brackets", "spaces", "top", "known"]
ROUNDS, DEPTH, RATE, LEAF, PRECISION, FLOOR, LINES, BLOCK, CONTEXT = 32, 3, 0.3, 8, 0.99, 0.5, 4000, 256, 40
#: Largest feature value told apart.
MOST = 63
SPAN = "s:int,k:int,e:int"


def located(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m, before>> of a pattern's matches, left to right, in time near linear in their number."""
    plain = F.translate(text, "\x01\x02", "\x03\x03")
    parts = F.split(F.regexp_replace(plain, pattern, "\x01$0\x02"), "\x01")

    def starts(p: Column) -> Column:
        lens = F.transform(p, lambda x, i: F.char_length(x) - F.when(i > 0, 1).otherwise(0))
        add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

        def summed(n: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / BLOCK).cast("int")), lambda b: add(F.slice(n, b * BLOCK + 1, BLOCK)))
            one = lambda i, b: add(F.slice(b, F.lit(1), F.floor(i / BLOCK).cast("int"))) + add(F.slice(n, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))
            return let(blocks, lambda b: F.transform(F.sequence(F.lit(1), F.size(n) - 1), lambda i: one(i, b)))

        return let(lens, summed)

    def spans(p: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            match = F.substring_index(F.get(p, i + 1), "\x02", 1)
            before = F.when(i == 0, F.get(p, F.lit(0))).otherwise(F.substring_index(F.get(p, i), "\x02", -1))
            return F.struct(s.alias("s"), (s + F.char_length(match)).cast("int").alias("e"), match.alias("m"), F.right(before, F.lit(CONTEXT)).alias("before"))

        none = F.array().cast("array<struct<s:int,e:int,m:string,before:string>>")
        return F.when(F.size(p) < 2, none).otherwise(let(starts(p), lambda at: F.transform(at, one)))

    return let(parts, spans)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), lambda a, k: a + let(F.coalesce(F.try_to_number(F.substring(d, F.length(d) - k + 1, F.lit(1)), F.lit("9")).cast("int"), F.lit(0)), lambda x: F.when(k % 2 == 0, twice(x)).otherwise(x)))
    return total % 10 == 0


def passes(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return n.between(12, 19) & luhn(digits(m))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


#: What a text must have for a base pattern to be worth a search.
WORTH = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<s, k, e>>: the contract's spans of a kind."""
    found = F.filter(located(text, BASE[kind]), lambda x: passes(kind, x["m"]))
    made = F.transform(found, lambda x: F.struct(x["s"].cast("int").alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))
    return F.when(text.rlike(WORTH[kind]), made).otherwise(F.array().cast(f"array<struct<{SPAN}>>"))


OCTET = "^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"


def features(kind: str, m: Column, before: Column) -> Column:
    """struct<FEATURES>, all integers."""
    runs = F.filter(F.split(m, "[^0-9]+"), lambda x: x != "")
    bare = digits(m)
    flag = lambda c: F.when(c, 1).otherwise(0)

    def of(runs: Column, bare: Column) -> Column:
        lens, n = F.transform(runs, lambda x: F.length(x)), F.length(bare)
        value = {
            "kind": F.lit(KINDS.index(kind)), "digits": n, "chars": F.char_length(m), "groups": F.size(runs), "longest": F.array_max(lens), "shortest": F.array_min(lens), "first": F.get(lens, F.lit(0)), "last": F.try_element_at(lens, F.lit(-1)),
            "zero": flag(bare.startswith("0")), "plus": flag(m.startswith("+")), "lead": F.left(bare, F.lit(1)).try_cast("int"),
            "marks": F.size(F.array_distinct(F.split(F.regexp_replace(m, "[0-9A-Za-z]", ""), ""))), "luhn": flag(n.between(12, 19) & luhn(bare)), "octets": flag((F.size(runs) == 4) & F.forall(runs, lambda p: p.rlike(OCTET))),
            "hint": flag(before.rlike(NAMED[kind] + _JOIN)), "near": flag(before.rlike(NAMED[kind])), "against": flag(before.rlike(NAMED["against"] + _JOIN)), "spelled": flag(m.rlike(f"(?i){_AT}")) + flag(m.rlike(r"(?i)[ (\[{<](?:dot|punkt|punto|point)[ )\]}>]")),
            "brackets": flag(m.rlike(r"[\[\](){}<>]")), "spaces": F.length(F.regexp_replace(m, "[^ ]", "")), "top": F.length(F.regexp_extract(m, "([A-Za-z]*)$", 1)), "known": flag(m.rlike(TOPS)),
        }
        return F.struct(*(F.least(F.coalesce(value[k].cast("int"), F.lit(0)), F.lit(MOST)).alias(k) for k in FEATURES))

    return let(F.struct(runs.alias("runs"), bare.alias("bare")), lambda x: of(x["runs"], x["bare"]))


def started_before(spans: Column, end: Column) -> Column:
    """How many of the spans, which are in order of start, start before `end`; by bisection."""
    steps = F.array(*(F.lit(1 << b) for b in range(23, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(spans, at + step - 1)["s"] < end, at + step).otherwise(at))


def overlaps(spans: Column, x: Column) -> Column:
    """Does x overlap any of the spans of one kind, which are in order and don't overlap one another?"""
    last = let(started_before(spans, x["e"]), lambda n: F.when(n > 0, F.get(spans, n - 1)["e"] > x["s"]).otherwise(False))
    return F.when(F.size(spans) == 0, F.lit(False)).otherwise(last)


def candidates(text: Column, kind: str, base: list[Column] = ()) -> Column:
    """array<struct<s, k, e, f>>: a generator's proposals that overlap no base span, with their features."""
    worth = {"email": text.rlike(r"(?i)@|\uFF20|[ \[({<](?:at|ät|a|à|arroba|arobase)[ \])}>]"), "ip": text.rlike("[0-9:]"), "card": text.rlike("[0-9]"), "phone": text.rlike("[0-9]")}[kind]
    free = located(text, LOOSE[kind])
    if base:
        free = F.filter(free, lambda x: ~reduce(or_, (overlaps(own, x) for own in base)))
    made = F.transform(free, lambda x: F.struct(x["s"].cast("int").alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), features(kind, x["m"], x["before"]).alias("f")))
    none = F.array().cast(f"array<struct<{SPAN},f:struct<{','.join(f'{k}:int' for k in FEATURES)}>>>")
    return F.when(worth, made).otherwise(none)


# ---- fitting -----------------------------------------------------------------------------------------------------------------------------


def training_lines(n: int = LINES, seed: int = 5) -> list[tuple[int, str, int, int]]:
    """(number, line, label, fold): personal data in loose forms, and look-alikes (dates, versions, amounts, order numbers, prose), each in
    some context. Fold 0 is for fitting, 1 for calibration: it takes its context words from the other half of STEMS and AGAINST."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))
    pick = lambda *x: r.choice(x)
    grouped = lambda text, sizes, sep: sep.join(text[sum(sizes[:k]) : sum(sizes[: k + 1])] for k in range(len(sizes)))

    def digits_with_check(n_: int, lead: str) -> str:
        body = lead + d(n_ - 1 - len(lead))
        total = sum((2 * int(c) - 9 * (2 * int(c) > 9)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def card() -> str:
        sep = pick(".", "/", "_", "  ", " - ", "\u00a0", "\u2013", " / ")
        amex = r.random() < 0.25
        number = digits_with_check(15, pick("34", "37")) if amex else digits_with_check(16, pick("4", "51", "55", "22", "6011"))
        return grouped(number, (4, 6, 5), sep) if amex else grouped(number, (4, 4, 4, 4), sep)

    def phone() -> str:
        sep = pick(" ", "-", ".", "/", "\u00a0")
        return pick(
            f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}){d(3)}{pick('-', ' ')}{d(4)}", sep.join((d(3), d(3), d(4))), f"1{sep}{d(3)}{sep}{d(3)}{sep}{d(4)}", f"0{d(3)}{pick('-', '/', ' ')}{d(pick(6, 7, 8))}", f"0{d(2)}{pick('-', '/', ' ')}{d(pick(6, 7, 8))}", f"0{d(2)} {d(3)} {d(4)}", f"(0{d(pick(2, 3, 4))}) {d(pick(5, 6, 7))}",
            "0" + d(1) + sep + sep.join(d(2) for _ in range(4)), f"{pick('6', '7', '9')}{d(2)}{sep}{d(3)}{sep}{d(3)}", f"{pick('6', '7', '9')}{d(2)}{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}", f"00{d(2)} {d(pick(2, 3))} {d(pick(3, 4))} {d(4)}", f"+{d(2)} (0){d(2)}/{d(pick(6, 7))}", f"+{d(2)}/{d(3)}/{d(7)}", f"0{d(pick(9, 10))}",
        )

    def email() -> tuple[str, bool]:
        at, dot, bare = pick((" at ", " dot ", True), ("(at)", ".", False), ("[at]", "[dot]", False), (" [at] ", " [dot] ", False), (" @ ", ".", False), (" (at) ", " (dot) ", False), ("{at}", "{dot}", False), (" arroba ", " punto ", True), (" at ", " punkt ", True), ("(a)", ".", False), (" arobase ", " point ", True), ("\uff20", ".", False), ("@", " . ", False), (" AT ", " DOT ", True))
        name = pick(f"{word()}.{word()}", f"{word()}{d(2)}", word(), f"{word()}_{word()}", f"{word()}.{d(2)}")
        return f"{name}{at}{word()}{dot}" + (f"{word()}{dot}" if r.random() < 0.2 else "") + pick("com", "net", "org", "de", "fr", "es", "uk", "io", "edu"), bare

    def address() -> str:
        part = lambda: f"{r.randint(0, 65535):x}"
        four = [str(r.randint(0, 255)) for _ in range(4)]
        k = r.randint(1, 5)
        return pick("[.]".join(four), "(.)".join(four), " . ".join(four), "{.}".join(four), " dot ".join(four), "[.]".join((".".join(four[:3]), four[3])), ":".join(part() for _ in range(8)), ":".join(part() for _ in range(k)) + "::" + ":".join(part() for _ in range(r.randint(1, 6 - k))))

    def good(words: dict[str, list[str]]) -> tuple[str, str]:
        kind = r.choice(KINDS)
        made, bare = email() if kind == "email" else ({"ip": address, "card": card, "phone": phone}[kind](), False)
        named = pick(*words[kind]) + pick("", ":", " " + pick("at", "is", "no", "unter", "al", "le", "on", "me at"))
        # what stands in plain words or plain digits is known by what names it; other forms mostly are, too
        if r.random() < 0.3:
            named += f" {word()} {pick('at', 'on', 'is', word())}"
        plain = bare or kind == "phone" and r.random() < 0.8
        return named if plain or r.random() < 0.7 else word(), made

    def bad(words: dict[str, list[str]]) -> tuple[str, str]:
        year, month, day = str(r.randint(1900, 2099)), f"{r.randint(1, 12):02}", f"{r.randint(1, 28):02}"
        made = pick(
            lambda: f"{year}-{month}-{day} {r.randint(0, 23):02}.{d(2)}", lambda: f"{day}.{month}.{year} - {day}.{month}.{year}", lambda: f"{day}/{month}/{year} {d(2)}", lambda: f"{year}-{year}", lambda: f"{year}/{month}/{day}", lambda: f"{day}.{month}.{year}", lambda: f"{year}{month}{day}-{d(6)}",
            lambda: f"{d(1)}.{d(1)}.{d(2)} . {r.randint(256, 999)}", lambda: f"{d(1)} . {d(1)} . {r.randint(256, 999)} . {d(1)}", lambda: d(r.choice([10, 11, 12, 13, 14, 15, 16, 16, 16, 18])), lambda: f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: " ".join(d(4) for _ in range(5)),
            lambda: f"{word()} at {word()}.{word()}", lambda: f"{word()} at {word()} dot {word()[:3]}", lambda: f"{word()} at {word()}.{word().capitalize()}", lambda: f"{word()} at {word()} point {word()}", lambda: f"{word()} (a) {word()}. {word()}", lambda: f"{word()} at the {word()} dot com", lambda: f"{word()} at {word()} dot {pick('com', 'net', 'org')}",
            lambda: f"{d(4)}.{d(4)}.{d(4)}.{d(4)}", lambda: f"{d(4)}/{d(4)}/{d(4)}/{d(4)}", lambda: f"{d(5)} {d(5)} {d(5)}", lambda: f"{d(1)},{d(3)},{d(3)}.{d(2)} {d(3)}.{d(2)}", lambda: f"{d(4)} / {d(4)} / {d(4)}", lambda: f"({d(4)}) {d(4)}", lambda: f"{d(2)} {d(3)} {d(3)}", lambda: f"{d(1)} {d(3)} {d(3)}", lambda: f"{d(2)}.{d(4)} {d(2)}.{d(4)}",
            lambda: f"{d(3)}-{d(3)}", lambda: f"{d(2)}-{d(2)}-{d(2)}", lambda: f"({year}) {d(2)}-{d(2)}", lambda: f"{pick('std', 'abc', 'a', 'f')}::{pick('b', 'add', 'c')}", lambda: f"{d(2)}:{d(2)}::{d(2)}", lambda: grouped(digits_with_check(16, d(2)), (4, 4, 4, 4), "/"),
        )()
        other = pick("phone", "card") if any(c.isalpha() for c in made) else "email"  # a name that doesn't fit
        return pick(word(), word(), pick(*words["against"]) + pick("", ":", " no"), pick(*words[other])), made

    halves = [{kind: words.split()[half::2] for kind, words in (STEMS | {"against": AGAINST}).items()} for half in (0, 1)]
    out = []
    for k in range(n):
        label, fold = int(r.random() < 0.5), k % 3 // 2
        hint, made = good(halves[fold]) if label else bad(halves[fold])
        out.append((k, f"{word()} {word()} {hint} {made} {word()} {word()}", label, fold))
    return out


class Trees:
    """Boosted trees, logistic loss, on small integers; and a threshold for each kind. Fold 0 fits, fold 1 calibrates."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        own = fold == 0
        self.start = float(np.log((y[own].mean() + 1e-3) / (1 - y[own].mean() + 1e-3)))
        self.trees: list[tuple] = []
        score = np.full(len(y), self.start)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            self.trees.append(self._grow(x, y - p, p * (1 - p), own, DEPTH))
            score += self._apply(self.trees[-1], x)
        p = 1 / (1 + np.exp(-score))
        self.threshold = []
        for k, kind in enumerate(KINDS):
            held = (fold == 1) & (x[:, 0] == k) & (p >= FLOOR)
            order = np.argsort(-p[held])
            right = np.cumsum(y[held][order]) / np.arange(1, held.sum() + 1)
            good = np.flatnonzero(right >= PRECISION)
            if not len(good):
                raise ValueError(f"no threshold keeps {PRECISION} for {kind}")
            self.threshold.append(float(p[held][order][good[-1]]) - 1e-9)

    def _grow(self, x, g, h, rows, depth) -> tuple:
        leaf = float(RATE * g[rows].sum() / (h[rows].sum() + 1.0))
        if not depth or rows.sum() < 2 * LEAF:
            return (leaf,)
        # sums of each feature's values, then of all up to each: every cut at once
        at = (x[rows] + np.arange(x.shape[1]) * (MOST + 1)).ravel()
        sums = [np.bincount(at, np.repeat(w[rows], x.shape[1]), x.shape[1] * (MOST + 1)).reshape(x.shape[1], -1).cumsum(axis=1) for w in (g, h, np.ones(len(g)))]
        (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
        gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
        gain[(nl < LEAF) | (nt - nl < LEAF)] = 0
        f, cut = np.unravel_index(gain.argmax(), gain.shape)
        if gain[f, cut] <= 1e-6:
            return (leaf,)
        left = rows & (x[:, f] <= cut)
        return int(f), int(cut), self._grow(x, g, h, left, depth - 1), self._grow(x, g, h, rows & ~left, depth - 1)

    def _apply(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, self._apply(low, x), self._apply(high, x))

    def column(self, f: Column) -> Column:
        """The probability as an expression over a struct of features."""

        def of(tree: tuple) -> Column:
            return F.lit(tree[0]) if len(tree) == 1 else F.when(f[FEATURES[tree[0]]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + of(tree)
        return 1 / (1 + F.exp(-total))


@lru_cache(maxsize=1)
def _examples() -> tuple:
    return tuple(training_lines())


_FITTED: list[Trees] = []


def fit(spark: SparkSession) -> Trees:
    """Fit once in a driver process; the features come from the same expressions that the scan uses."""
    if not _FITTED:
        lines = spark.createDataFrame(list(_examples()), "n int, line string, label int, fold int").repartition(8)
        lines = lines.select("*", *(base_spans(F.col("line"), k).alias(f"base_{k}") for k in KINDS))
        both = F.concat(*(candidates(F.col("line"), k, [F.col(f"base_{b}") for b in KINDS]) for k in KINDS))
        rows = lines.select("n", "label", "fold", F.explode(both).alias("c")).select("n", "label", "fold", "c.k", *(F.col(f"c.f.{k}").alias(k) for k in FEATURES)).collect()
        rows.sort()
        x = np.array([[r[k] for k in FEATURES] for r in rows])
        _FITTED.append(Trees(x, np.array([float(r.label) for r in rows]), np.array([r.fold for r in rows])))
    return _FITTED[0]


def chosen(sure: Column) -> Column:
    """Of array<struct<p, s, k, e>>: the best first, each that overlaps none taken before; array<struct<s, k, e>> in order of start.

    Spans are first cut into runs in which each overlaps what came before it; only within a run is every pair looked at. What is taken is kept
    in pages, so that adding to it copies little.
    """
    pick = lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))
    over = lambda a, b: (a["s"] < b["e"]) & (b["s"] < a["e"])
    spans, run = f"array<struct<{SPAN}>>", "array<struct<p:double,s:int,k:int,e:int>>"

    def best(own: Column) -> Column:
        ranked = F.transform(F.sort_array(F.transform(own, lambda c: F.struct((-c["p"]).alias("p"), c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))), pick)
        kept = F.aggregate(ranked, F.array().cast(spans), lambda acc, c: F.when(F.exists(acc, lambda o: over(o, c)), acc).otherwise(F.concat(acc, F.array(c))))
        return F.when(F.size(own) <= 1, F.transform(own, pick)).otherwise(F.sort_array(kept))

    def step(acc: Column, c: Column) -> Column:
        new, full = c["s"] >= acc["reach"], F.size(acc["page"]) >= BLOCK
        page = F.when(~new, acc["page"]).when(full, best(acc["run"])).otherwise(F.concat(acc["page"], best(acc["run"])))
        return F.struct(
            F.when(new & full, F.concat(acc["pages"], F.array(acc["page"]))).otherwise(acc["pages"]).alias("pages"), page.alias("page"),
            F.when(new, F.array(c)).otherwise(F.concat(acc["run"], F.array(c))).alias("run"), F.greatest(acc["reach"], c["e"]).alias("reach"),
        )

    ordered = F.array_sort(F.transform(sure, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), c["p"].alias("p"))))
    ordered = F.transform(ordered, lambda c: F.struct(c["p"].alias("p"), c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))
    zero = F.struct(F.array().cast(f"array<{spans}>").alias("pages"), F.array().cast(spans).alias("page"), F.array().cast(run).alias("run"), F.lit(0).alias("reach"))
    many = F.aggregate(ordered, zero, step, lambda acc: F.flatten(F.concat(acc["pages"], F.array(acc["page"], best(acc["run"])))))
    return F.when(F.size(sure) <= 1, F.transform(sure, pick)).otherwise(many)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: Trees | None = None) -> DataFrame:
    """doc_id, text, base and added: array<struct<s, k, e>>, each in order of start and kind."""
    trees = trees or fit(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    found = rows.select("doc_id", "text", *(base_spans(F.col("text"), k).alias(f"base_{k}") for k in KINDS))
    base = [F.col(f"base_{k}") for k in KINDS]
    found = found.select("doc_id", "text", F.sort_array(F.concat(*base)).alias("base"), F.concat(*(candidates(F.col("text"), k, base) for k in KINDS)).alias("proposed"))
    limits = F.array(*(F.lit(t) for t in trees.threshold))
    scored = F.transform("proposed", lambda c: F.struct(trees.column(c["f"]).alias("p"), c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))
    found = found.select("doc_id", "text", "base", F.filter(scored, lambda c: c["p"] >= F.get(limits, c["k"])).alias("sure"))
    return found.select("doc_id", "text", "base", chosen(F.col("sure")).alias("added"))


def redacted(found: DataFrame) -> DataFrame:
    """doc_id, text with every span replaced by its kind in brackets; overlapping spans as one, named by the first."""
    names = F.array(*map(F.lit, KINDS))

    def step(acc: Column, s: Column) -> Column:
        out = F.when(s["s"] >= acc["at"], F.concat(acc["out"], F.substring("text", acc["at"] + 1, s["s"] - acc["at"]), F.lit("["), F.upper(F.get(names, s["k"])), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["e"]).alias("at"), out.alias("out"))

    ordered = F.sort_array(F.concat("base", "added"))
    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.char_length("text"))))
    return found.select("doc_id", done.alias("text"))


def listed(s: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = spans(docs)
    of_kind = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
