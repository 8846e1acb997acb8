"""Personal information in free text: a skip-chain conditional random field over candidate spans."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import spread, stage

KINDS = ("none", "email", "phone", "identity", "address", "name")
NONE, EMAIL, PHONE, IDENTITY, ADDRESS, NAME = range(6)
#: Labels that a candidate of each type may take.
ALLOWED = {"E": (NONE, EMAIL), "N": (NONE, PHONE, IDENTITY), "I": (NONE, IDENTITY), "A": (NONE, ADDRESS), "P": (NONE, NAME)}
SAMPLE_DOCS = 4000  # documents, chosen by hash, that the weights are fitted on
ROUNDS, JOINT_ROUNDS, SWEEPS = 80, 8, 4  # gradient steps of the features alone, and of features and potentials together; sweeps of message passing

# Words of streets, cues and particles in English, French, German and Spanish.
STREET_EN = "Row|Street|St\\.?|Quay|Crescent|Lane|Ln\\.?|Road|Rd\\.?|Place|Terrace|Close|Hill|Walk|Avenue|Ave\\.?|Yard|Square|Sq\\.?|Way|Gate|Court|Ct\\.?|Drive|Dr\\.?|Boulevard|Blvd\\.?"
STREET_FR = "rue|avenue|boulevard|quai|place|allée|chemin|impasse|cours|passage"
STREET_DE = "str\\.|straße|strasse|platz|gasse|weg|allee|ufer|damm|ring|markt"
STREET_ES = "Calle|C/|Avenida|Avda\\.|Av\\.|Plaza|Paseo|Carrera|Camino|Ronda|Travesía"
PARTICLES = "de la|de las|de los|de|del|della|di|da|van der|van de|van den|van|von der|von|zu|la|le|den|der|ten|ter|bin|ibn|al|el|dos|du|st\\."
CUES = {
    PHONE: "tel tel. telephone phone fax call ring mobile cell téléphoner téléphone tél tél. llamar teléfono móvil telefon erreichbar anrufen handy",
    IDENTITY: "ssn passport card identity insurance number numéro número documento ausweis passeport pasaporte carte dni nie no. nr. reisepass versicherungsnummer nummer",
    NONE: "oclc isbn issn barcode control box page pages price priced crowns shelf version plate strichcode code-barres código preis prix precio coronas couronnes kronen cote signatura signatur seite página volume vol. item",
}
CUE_OF = {w: k for k, ws in CUES.items() for w in ws.split()}
VAGUE = frozenset("number numéro número nummer no. nr. its".split())  # says no more than the word before it
FILE_ENDS = frozenset("tif tiff jpg jpeg png gif svg pdf txt doc docx csv zip html py js css mp3 mp4 wav".split())

UP = "A-ZÀ-ÖØ-Þ"
ENDS_DE = tuple(w + " " for w in STREET_DE.replace("\\", "").split("|"))
ENDS_DE += tuple(w.upper() for w in ENDS_DE)
WORDS_ES = tuple(STREET_ES.replace("\\", "").split("|"))
WORDS_ES += tuple(w.upper() for w in WORDS_ES)
WORDS_FR = tuple(STREET_FR.split("|"))
TOWN = rf"(?:@PLACES@|[{UP}][\w'’]+(?:-[\w'’]+)*)"
POST = r"(?:[A-Z]{2}\s\d{5}|[A-Z]{1,2}\d{1,2}[A-Z]?\s\d[A-Z]{2})"
TAIL_EN = rf"(?:(?:,\s+|\n){TOWN}(?:,?\s+{POST})?)?"
TAIL_NUM = rf"(?:(?:,\s+|\n)\d{{4,5}}\s+{TOWN})?"
UNIT = r"(?:(?:Flat|Unit|Apt\.?|Apartment|Suite|Room)\s+\w{1,4},\s+)?"
EMAIL_AT = re.compile(r"(?<![\w.+%-])[\w.+%'-]*[\w+%'-]@[\w-]+(?:\.[\w-]+)+", re.UNICODE)
EMAIL_SPELT = re.compile(r"(?<![\w.+%-])[\w.+%-]*\w(?:\s?[\[({]\s?at\s?[\])}]\s?|\sat\s)[\w-]+(?:(?:\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s|\.)[\w-]+)+", re.IGNORECASE)
NUMBER = re.compile(r"(?<![\w@./+-])(?:[A-Z]{1,2}-?)?[(]?[+]?\d+(?:(?:\)[ \n]?|[ \n]\(|[ .\-/\n])\d+)*(?:-?[A-Za-z](?!\w))?(?![\w@])")
WORDISH = re.compile(r"[^\s,;:\"“”()\[\]{}<>=]+")
#: Forms of address, and words before a year.
ADDRESSED = frozenset("mr mrs ms miss dr prof sir lady dame rev mme mlle monsieur madame mademoiselle maître herr frau fräulein señor señora señorita don doña sra srta".split())
BEFORE_YEAR = frozenset("in since by after before until during en depuis dès vers avant après im jahr seit bis ab nach vor desde hasta hacia".split())


#: Lines of contacts, each with a sign that it holds, where texts have such: they tell a first name from a surname even if hardly anyone else bears it.
SLOTS = (
    ("onta", re.compile(r"(?:Contact|Kontakt|Contacto)\s?:\s([^,\n@]{3,50})(?:,\s([^,\n@]{2,40}))?,\s\S*(?:@|\(at\)|\[at\]|\sat\s)")),
    ('"reader"', re.compile(r"\"reader\":\s\"([^\",]{3,50})(?:,\s([^\"]{2,40}))?\"")),
    (";mail=", re.compile(r"\bname=([^;,\n]{3,50})(?:,\s([^;\n]{2,40}))?;mail=")),
)
ORDINARY = re.compile(r"(?<=[a-z,] )[a-zß-ÿ]{4,}")
CAPITAL = re.compile(r"(?<![\w.])[A-ZÀ-ÖØ-Þ][^\W\d_]{2,}")
NAMED = re.compile(rf"(?<![\w.'’-])([{UP}][^\W\d_]{{2,}})(?:-[{UP}][^\W\d_]+)?(?:\s[{UP}]\.)*(?:\s(?:{PARTICLES}))?\s(?:[dO]['’])?([{UP}][^\W\d_]{{4,}})(?!['’]?\w)")


def lower(t: str) -> str:
    """Lower case, character by character where the whole would have another length: offsets stay those of the text."""
    low = t.lower()
    return low if len(low) == len(t) else "".join(x if len(x := c.lower()) == 1 else c for c in t)


class Taken:
    """Intervals that don't overlap, in order: whether another one is free of them takes a search, not a walk."""

    def __init__(self):
        self.held: list[tuple[int, int]] = []

    def add(self, a: int, b: int) -> None:
        insort(self.held, (a, b))

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.held, (b,))
        return not i or self.held[i - 1][1] <= a


def fold(s: str) -> str:
    return unicodedata.normalize("NFC", s).lower()


class Finder:
    """Candidate spans of a text; `first` are known first names in lower case, `ends` known endings of surnames, `places` names of towns of several words."""

    def __init__(self, first: frozenset, ends: frozenset, ordinary: frozenset, places: tuple[str, ...]):
        self.first, self.ends, self.ordinary = first, ends, ordinary
        several = "|".join(sorted((re.escape(p).replace(r"\ ", r"\s") for p in places if " " in p or "-" in p), key=len, reverse=True)) or "(?!)"
        c = lambda p: re.compile(p.replace("@PLACES@", several + "|" + several.upper().replace(r"\S", r"\s")))
        both = lambda p: f"(?:{p}|{p.upper()})"
        # each street form is looked for only around its digits: `pre` forms hold words before the number
        self.after = c(rf"(?:{UNIT}\d{{1,4}}[a-z]?\s+(?:St\.\s+)?(?:[{UP}][\w'’-]+\s+){{1,3}}{both(STREET_EN)}(?!\w){TAIL_EN}|\d{{1,4}}\s?[a-z]?(?:\s(?:bis|ter|quater|BIS|TER))?,?\s+{both(STREET_FR)}\s[^\n,.;]{{2,40}}?(?=[,\n.;]|\s\d|$){TAIL_NUM})")
        self.box = c(rf"(?:(?:P\.?\s?O\.?\s)?Box\s+\d{{1,6}}{TAIL_EN}|(?:BP|Postfach|Apartado|Apdo\.)\s+\d[\d ]{{0,6}}\d{TAIL_NUM})")
        self.german = c(rf"[{UP}ÄÖÜ][\w-]*{both(STREET_DE)}\s+\d{{1,4}}\s?[a-z]?(?!\w){TAIL_NUM}")
        self.spanish = c(rf"{both(STREET_ES)}\s+[^\n\d,]{{2,40}}?,?\s+(?:n\.º\s*)?\d{{1,4}}\s?[a-z]?(?!\w)(?:,\s(?:\d+\.[ºª]\s\w+\.?|bajo|ático|piso\s\w+))?{TAIL_NUM}")
        self.unit = re.compile(rf"{UNIT[:-1]}\Z")
        self.first_words = ahocorasick.Automaton()
        for f in first:
            self.first_words.add_word(f, len(f))
        if first:
            self.first_words.make_automaton()
        surname = r"(?:[dDoO]['’])?[^\W\d_]{3,}(?:['’][^\W\d_]+)?(?:-(?:[dDoO]['’])?[^\W\d_]{2,})?"
        self.forward = re.compile(rf"(?P<f>[^\W\d_]+(?:-[^\W\d_]+)?)(?P<i>(?:\s[A-Za-z]\.)*)(?P<p>(?:\s(?:{PARTICLES}))?)\s(?P<s>{surname})", re.IGNORECASE)
        self.backward = re.compile(rf"(?P<s>(?:(?:{PARTICLES})\s)?{surname}),\s$", re.IGNORECASE)
        self.given = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?(?:\s[A-Za-z]\.(?!\w))*")
        self.initials = re.compile(rf"(?<![\w.'’-])(?:[{UP}]\.\s?){{1,3}}(?:(?:{PARTICLES})\s)?(?P<s>(?:[dO]['’])?[{UP}][^\W\d_]{{2,}}(?:-[{UP}][^\W\d_]{{2,}})?)")

    def surname(self, s: str) -> bool:
        low = fold(s)
        return low[-3:] in self.ends and low not in self.ordinary

    def spans(self, t: str) -> list[tuple[int, int, str]]:
        """(begin, end, type) of candidates, none within another; earlier kinds of the order E, A, N, P win."""
        out: list[tuple[int, int, str]] = []
        if "@" in t:
            out += [(m.start(), m.end(), "E") for m in EMAIL_AT.finditer(t)]
        if "dot" in t or "DOT" in t or "[at]" in t or "(at)" in t:
            out += [(m.start(), m.end(), "E") for m in EMAIL_SPELT.finditer(t)]
        taken = Taken()
        for a, b, _ in out:
            taken.add(a, b)
        free = taken.free
        numbers = [m.span() for m in NUMBER.finditer(t)]
        for a, b in numbers:
            got = None
            if b - a <= 8 or "\n" in t[a:b]:
                nxt = t[b : b + 2]
                if nxt[:1] in " ," and (nxt[1:].isupper() or nxt[1:].islower() and any(w in t[b : b + 18] for w in WORDS_FR) or nxt[:1] == ","):
                    m = self.after.match(t, a)
                    if m:
                        u = self.unit.search(t[max(0, a - 22) : a])
                        got = (a - len(u[0]) if u else a, m.end())
                if got is None and t[a - 1 : a] in " ":
                    ctx = t[max(0, a - 60) : a]
                    if ctx.endswith(("ox ", "OX ", "BP ", "Postfach ", "Apartado ", "Apdo. ")):
                        for m in self.box.finditer(t, max(0, a - 12), min(len(t), b + 60)):
                            if m.start() <= a < m.end():
                                got = m.span()
                    elif ctx.endswith(ENDS_DE):
                        for m in self.german.finditer(t, max(0, a - 60), min(len(t), b + 60)):
                            if m.start() <= a < m.end():
                                got = m.span()
                    else:
                        k = max([ctx.rfind(w) for w in WORDS_ES if w in ctx], default=-1)
                        if k >= 0:
                            m = self.spanish.match(t, max(0, a - 60) + k)
                            if m and m.start() <= a < m.end():
                                got = m.span()
            if got and free(*got):
                # a room or box may stand before: "Flat 12, 23b ..." begins with another number
                out.append((*got, "A"))
                taken.add(*got)
        for a, b in numbers:
            s = t[a:b]
            pieces = [(a, b)]
            if "\n" in s and not PHONEISH.fullmatch(s.replace("\n", " ")):
                pieces, at = [], a
                for part in s.split("\n"):
                    pieces.append((at, at + len(part)))
                    at += len(part) + 1
            for x, y in pieces:
                digits = sum(c.isdigit() for c in t[x:y])
                if digits >= 6 and free(x, y):
                    out.append((x, y, "N"))
        for a, b, k in out:
            if k == "N":
                taken.add(a, b)
        if self.first:
            low = lower(t)
            for end, n in self.first_words.iter(low):
                a, b = end + 1 - n, end + 1
                if (a and (low[a - 1].isalpha() or low[a - 1] == "@")) or (b < len(low) and low[b].isalpha()):
                    continue
                if a and low[a - 1] == "-" and a > 1 and low[a - 2].isalpha():
                    continue
                if not free(a, a + 1):
                    continue
                m = self.forward.match(t, a)
                got = None
                if m and self.surname(m["s"]):
                    got = m.span()
                elif m and "-" in m["s"] and self.surname(m["s"].split("-")[0]):
                    got = (a, m.start("s") + m["s"].index("-"))
                else:
                    r = self.backward.search(t, max(0, a - 45), a)
                    if r and self.surname(r["s"]):
                        g = self.given.match(t, a)
                        got = (r.start("s"), g.end() if g else b)
                if got and free(*got):
                    out.append((*got, "P"))
                    taken.add(*got)
        dot, past = t.find("."), 0
        while dot >= 0:  # an initial ends with a point, and points are few
            if dot > past and t[dot - 1].isupper():
                m = self.initials.match(t, dot - 1)
                if m:
                    past = m.end()
                    if self.surname(m["s"]) and free(*m.span()):
                        out.append((*m.span(), "P"))
                        taken.add(*m.span())
            dot = t.find(".", dot + 1)
        out.sort()
        return out


PHONEISH = re.compile(r"(?:\(?\+?\d{1,4}\)?[ .\-/]?)(?:\(?\d{1,5}\)?[ .\-/]?){1,5}\d{2,6}")


def cue_of(left: list[str]) -> int:
    """The label that the words before a number speak for, -1 if none does."""
    for i in range(len(left) - 1, -1, -1):
        if left[i] in CUE_OF:
            if left[i] in VAGUE and i and left[i - 1] in CUE_OF:
                return CUE_OF[left[i - 1]]
            return CUE_OF[left[i]]
    return -1


def features(t: str, a: int, b: int, kind: str, finder: Finder) -> list[str]:
    """What the field sees of a candidate: its shape and the words on either side."""
    s = t[a:b]
    left = WORDISH.findall(t[max(0, a - 40) : a].lower())[-3:]
    right = WORDISH.findall(t[b : b + 24].lower())[:1]
    out = [kind, *(f"{kind}l{w}" for w in left[-2:]), f"{kind}r{right[0] if right else ''}"]
    if kind == "N":
        shape = re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s))
        digits = re.sub(r"\D", "", s)
        cue = cue_of(left)
        out += [f"Ns{shape}", f"Nn{len(digits)}", f"Nc{cue}", f"Ns{shape}c{cue}", f"Np{digits[:1]}n{len(digits)}", f"Nh{s[:1] in '+('}", f"Nb{sum(not c.isdigit() for c in s)}n{len(digits)}"]
    elif kind == "E":
        end = s.lower().rpartition(".")[2].rpartition(" ")[2]
        out += [f"Ee{end}", f"Ef{end in FILE_ENDS}", f"Ed{s.partition('@')[2][:1].isdigit()}"]
    elif kind == "P":
        words = s.split()
        out += [f"Pe{fold(s)[-4:]}", f"Pn{len(words)}", f"Pc{'u' if s.isupper() else 'l' if s.islower() else 't'}", f"Pk{',' in s}", f"Pi{'.' in s}"]
    else:
        out += [f"Ad{sum(c.isdigit() for c in s)}", f"Ac{s.count(',') + s.count(chr(10))}"]
    return out


def silver(t: str, a: int, b: int, kind: str, mails: list[tuple[int, int]]) -> int | None:
    """A label where the words around a candidate leave no doubt, else None; `mails` are the addresses with @ in the text."""
    left = WORDISH.findall(t[max(0, a - 40) : a].lower())[-3:]
    if kind == "E":
        end = t[a:b].lower().rpartition(".")[2]
        return NONE if end in FILE_ENDS or t[a:b].partition("@")[2][:1].isdigit() else EMAIL
    if kind == "A":
        year = re.match(r"(1[5-9]|20)\d\d\s", t[a:b])
        return NONE if year and left and left[-1] in BEFORE_YEAR else ADDRESS
    if kind == "P":
        after = CAPITAL.match(t, b + 1) if t[b : b + 1] == " " else None
        if left and left[-1].strip(".") in ADDRESSED or any(x - 200 < b and a < y + 200 and set(re.findall(r"[^\W\d_]{4,}", fold(t[x:y]))) & set(re.findall(r"[^\W\d_]{4,}", fold(t[a:b]))) for x, y in mails):
            return NAME
        return NONE if after else NAME if "," not in t[a:b] and t[a:b][:1].isupper() else None
    if re.fullmatch(r"\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}[./-]\d{1,2}[./-]\d{1,2}", t[a:b]):
        return NONE
    cue = cue_of(left)
    if cue >= 0:
        return cue
    if t[a:b][:1].isalpha() or t[a:b][-1:].isalpha():
        return IDENTITY
    # the number right after a mail address, as in a line of contacts
    return PHONE if t[:a].rstrip()[-1:] in (",", "=", ";") and any(y <= a < y + 12 for x, y in mails) else None


def similar_keys(t: str, a: int, b: int, kind: str) -> list[str]:
    """What makes two candidates of a document similar: equal digits, an equal word of a name, an equal mail domain."""
    s = t[a:b]
    if kind == "N":
        return ["N" + re.sub(r"\D", "", s)[-7:]]
    if kind == "P":
        return ["P" + w for w in re.findall(r"[^\W\d_]{4,}", fold(s))]
    if kind == "E":
        return ["E" + fold(s).partition("@")[2]]
    return ["A" + fold(s)[:12]]


def edges_of(t: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """(i, j, 0) for neighbours within 160 characters, (i, j, 1) for each candidate and the last one similar to it."""
    out = [(i, i + 1, 0) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] <= 160]
    last: dict[str, int] = {}
    for j, (a, b, k) in enumerate(spans):
        for key in similar_keys(t, a, b, k):
            if key in last and last[key] != j:
                out.append((last[key], j, 1))
            last[key] = j
    return out


def propagate(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, sweeps: int = SWEEPS, joint: bool = False):
    """Beliefs (log, unnormalised) of all nodes of many documents' graphs by loopy sum-product message passing; with `joint` also the probabilities of each edge's pairs of labels.

    edges: (i, j, type); pair[type]: log potentials. Messages are damped by half and updated all at once.
    """
    if not len(edges):
        return (unary, np.zeros((0, unary.shape[1], unary.shape[1]))) if joint else unary
    i, j, w = edges[:, 0], edges[:, 1], pair[edges[:, 2]]
    fwd, bwd = np.zeros((len(edges), unary.shape[1])), np.zeros((len(edges), unary.shape[1]))
    norm = lambda x: x - x.max(1, keepdims=True)

    def beliefs():
        b = unary.copy()
        np.add.at(b, j, fwd)
        np.add.at(b, i, bwd)
        return b

    for _ in range(sweeps):
        b = beliefs()
        out_i, out_j = norm(b[i] - bwd), norm(b[j] - fwd)
        new_f = norm(np.log(np.exp(out_i[:, :, None] + w).sum(1) + 1e-300))
        new_b = norm(np.log(np.exp(out_j[:, None, :] + w).sum(2) + 1e-300))
        fwd, bwd = 0.5 * fwd + 0.5 * new_f, 0.5 * bwd + 0.5 * new_b
    b = beliefs()
    if not joint:
        return b
    e = norm(b[i] - bwd)[:, :, None] + w + norm(b[j] - fwd)[:, None, :]
    e = np.exp(e - e.max((1, 2), keepdims=True))
    return b, e / e.sum((1, 2), keepdims=True)


def mask_of(s: str, kind: str) -> np.ndarray:
    """Log potentials of a candidate's type: a number with a letter at an end is no phone number."""
    return MASK["I" if kind == "N" and (s[0].isalpha() or s[-1].isalpha()) else kind]


MASK = {k: np.array([0.0 if j in allowed else -1e6 for j in range(len(KINDS))]) for k, allowed in ALLOWED.items()}


COUNTED = "kind string, word string, other string, n long"
HELD = 200_000  # counts that a task holds before it hands them on


def count_words(texts, seen: dict[str, Counter]) -> None:
    """Counts by kind: o words in lower case, c capitalised words, b capitalised words before another, initials and particles between them aside, f first names and e surname endings of lines of contacts."""
    for t in texts:
        seen["o"].update(ORDINARY.findall(t))
        seen["c"].update(CAPITAL.findall(t))
        seen["b"].update(NAMED.findall(t))
        for sign, slot in SLOTS:
            for m in slot.finditer(t) if sign in t else ():
                given, rest = (m[2], m[1]) if m[2] else ((m[1].split() or [""])[0], " ".join(m[1].split()[1:]))
                seen["f"].update(re.findall(r"[^\W\d_]{3,}", fold(given)))
                seen["e"].update(s[-3:] for s in re.findall(r"[^\W\d_]{4,}", fold(rest)))


#: What makes names: different partners of a first name and different surnames of an ending, the share of the most frequent one, how much a word is written in lower case, the share of a first name's uses.
PARTNERS, TOP_SHARE, LOWER_SHARE, AS_FIRST, OF_ALL = 4, 0.34, 0.5, 0.5, 0.2


def lexicons(df: DataFrame, text: str = "text") -> dict:
    """First names, surname endings and ordinary words from all rows' texts, counted in one pass over them; no form of text is presupposed.

    Names show in how words combine: a first name stands before many different capitalised words, none of which is most of them, and
    surnames come in many different forms with few endings, after different first names, while the parts of other proper names have fixed
    partners, or are words that are mostly written in lower case. So endings are those of PARTNERS different words at least that follow
    such words, and first names the words that stand before surnames so ending, in at least AS_FIRST of their pairs and
    OF_ALL of their uses. Lines of contacts, where there are any, name both too, and 5 sightings before a surname are enough if they are 0.4 of a word's. Forms of address are none. Ordinary words: 20 and one for each 100 texts. Only what reaches these bounds comes to the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {k: Counter() for k in "ocbfe"}

        def held():
            rows = [(k, fold(w[0]), fold(w[1]), n) if k == "b" else (k, fold(w) if k == "c" else w, "", n) for k, c in seen.items() for w, n in c.items()]
            for c in seen.values():
                c.clear()
            return pd.DataFrame(rows, columns=["kind", "word", "other", "n"])

        for pdf in batches:
            count_words(pdf[text], seen)
            if sum(map(len, seen.values())) > HELD:
                yield held()
        yield held()

    some = df.where(F.length(text) > 0).select(text)
    n = some.count()
    counts = stage(spread(some).mapInPandas(run, COUNTED).groupBy("kind", "word", "other").agg(F.sum("n").alias("n")), "names")
    words = lambda kind, least: frozenset(r[0] for r in counts.where((F.col("kind") == kind) & (F.col("n") >= least)).select("word").collect())
    common = words("o", max(20, n // 100))
    none = [*PARTICLES.split("|"), *ADDRESSED]
    low = counts.where("kind = 'o'").select("word", F.col("n").alias("low"))
    capital = counts.where("kind = 'c'").select("word", F.col("n").alias("cap")).join(low, "word", "left")
    proper = capital.where((F.coalesce("low", F.lit(0)) <= F.lit(LOWER_SHARE) * F.col("cap")) & ~F.col("word").isin(none)).select("word", "cap")
    pairs = counts.where("kind = 'b'").join(proper, "word").join(proper.select(F.col("word").alias("other")), "other").select("word", "cap", "other", F.substring("other", -3, 3).alias("end"), "n")
    pairs = stage(pairs, "name-pairs")
    many = pairs.groupBy("word").agg(F.count("*").alias("d"), F.max("n").alias("top"), F.sum("n").alias("total")).where((F.col("d") >= PARTNERS) & (F.col("top") <= F.lit(TOP_SHARE) * F.col("total")))
    after = pairs.join(many.select("word"), "word", "left_semi")
    shapes = after.select("end", "other").distinct().groupBy("end").agg(F.count("*").alias("d"))
    partners = after.select("end", "word").distinct().groupBy("end").agg(F.count("*").alias("words"))
    ends = shapes.join(partners, "end").where((F.col("d") >= PARTNERS) & (F.col("words") >= 2))
    ends = words("e", 4) | frozenset(r[0] for r in ends.select("end").collect())  # at most the endings of three letters that are common enough
    of = F.when(F.col("end").isin(*ends), F.col("n")).otherwise(0) if ends else F.lit(0)
    first = pairs.groupBy("word").agg(F.sum(of).alias("before"), F.count_if(of > 0).alias("d"), F.sum("n").alias("total"), F.max("cap").alias("cap"))
    varied = (F.col("before") >= 3) & (F.col("d") >= 2) & (F.col("before") >= F.lit(AS_FIRST) * F.col("total")) & (F.col("before") >= F.lit(OF_ALL) * F.col("cap"))
    first = first.where(varied | ((F.col("before") >= 5) & (F.col("before") >= F.lit(0.4) * F.col("cap"))))
    return {"first": words("f", 2) | frozenset(r[0] for r in first.select("word").collect()), "ends": ends, "ordinary": common}


def fit(texts: list[str], lexicon: dict, places: tuple[str, ...]) -> dict:
    """The model: `lexicon`, the lexicons of all texts, and from a sample of texts the weights of features and the potentials of neighbours and of similar candidates.

    Nothing is labelled by hand: candidates whose surroundings leave no doubt are the labelled nodes. A multinomial
    logistic regression of the features on them is the start; then features and pair potentials are fitted together as one field, by the
    difference of what message passing expects with the labels given and without.
    """
    first, ends_, common = lexicon["first"], lexicon["ends"], lexicon["ordinary"]
    finder = Finder(first, ends_, common, places)
    feats, masks, labels, edges = [], [], [], []
    for t in texts:
        spans = finder.spans(t)
        mails = [(a, b) for a, b, k in spans if k == "E" and "@" in t[a:b]]
        base = len(feats)
        for a, b, k in spans:
            feats.append(features(t, a, b, k, finder))
            masks.append(mask_of(t[a:b], k))
            labels.append(silver(t, a, b, k, mails))
        edges += [(base + i, base + j, e) for i, j, e in edges_of(t, spans)]
    names: dict[str, int] = {}
    ids = [[names.setdefault(f, len(names)) for f in fs] for fs in feats]
    n, L = len(ids), len(KINDS)
    w = np.zeros((max(len(names), 1), L))
    prior = np.stack([np.zeros((L, L)), 0.5 * np.eye(L)])  # similar candidates tend to one label, unless the texts say otherwise
    pair = prior.copy()
    if n:
        row = np.repeat(np.arange(n), [len(x) for x in ids])
        col = np.array([i for x in ids for i in x])
        mask = np.array(masks)
        y = np.array([-1 if v is None or m[v] < 0 else v for v, m in zip(labels, masks, strict=True)])

        def scores():
            s = mask.copy()
            np.add.at(s, row, w[col])
            return s

        known = y >= 0
        onehot = np.zeros((n, L))
        onehot[known, y[known]] = 1
        soft = lambda s: (p := np.exp(s - s.max(1, keepdims=True))) / p.sum(1, keepdims=True)
        g2, g2_pair = np.full_like(w, 1e-6), np.full_like(pair, 1e-6)

        def step(d: np.ndarray) -> None:
            g = np.zeros_like(w)
            np.add.at(g, col, d[row])
            g = g / max(known.sum(), 1) - 1e-5 * w
            g2[:] += g * g
            w[:] += 0.3 * g / np.sqrt(g2)

        for _ in range(ROUNDS):
            step((onehot - soft(scores())) * known[:, None])
        links = np.array(edges, np.int64).reshape(-1, 3)
        for _ in range(JOINT_ROUNDS if known.any() else 0):
            s = scores()
            free, free_edges = propagate(s, links, pair, 2, joint=True)
            given, given_edges = propagate(s + np.where(known[:, None], (onehot - 1) * 1e4, 0.0), links, pair, 2, joint=True)
            step(soft(given) - soft(free))
            g = np.zeros_like(pair)
            np.add.at(g, links[:, 2], given_edges - free_edges)
            g = g / max(len(links), 1) - 1e-3 * (pair - prior)
            g2_pair += g * g
            pair += 0.1 * g / np.sqrt(g2_pair)
    return {"first": first, "ends": ends_, "ordinary": common, "places": places, "weights": {f: w[i] for f, i in names.items() if np.abs(w[i]).max() > 0.02}, "pair": pair}


def label_batch(texts, model: dict, finder: Finder) -> list[list[tuple[int, int, int]]]:
    """(begin, end, kind) for each text, by message passing over all texts' candidates at once."""
    unary, edges, where = [], [], []
    weights = model["weights"]
    for no, t in enumerate(texts):
        if not t:
            continue
        spans = finder.spans(t)
        base = len(unary)
        for a, b, k in spans:
            u = mask_of(t[a:b], k).copy()
            for f in features(t, a, b, k, finder):
                x = weights.get(f)
                if x is not None:
                    u += x
            unary.append(u)
            where.append((no, a, b))
        if len(spans) > 1:
            edges += [(base + i, base + j, e) for i, j, e in edges_of(t, spans)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if unary:
        best = propagate(np.array(unary), np.array(edges, np.int64).reshape(-1, 3), model["pair"]).argmax(1)
        for (no, a, b), k in zip(where, best.tolist(), strict=True):
            if k:
                out[no].append((a, b, k))
    return out


def fit_pii(df: DataFrame, key: str, text: str = "text", places: tuple[str, ...] = (), sample_docs: int = SAMPLE_DOCS) -> dict:
    """Lexicons from all texts, weights by fit() on at most `sample_docs` texts, chosen by a hash of the key so that any order of rows gives the same."""
    n = df.count()
    share = min(1.0, 1.2 * sample_docs / max(n, 1))
    some = df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))).where(F.length(text) > 0)
    rows = some.select(text).orderBy(F.xxhash64(key)).limit(sample_docs).collect()  # bounded by sample_docs
    return fit([r[0] for r in rows], lexicons(df, text), places)


def find_pii(df: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, begin, end, kind, pii) for each place; begin and end count characters from 0. Whole texts; null and empty ones give no rows. Each row of df counts by itself."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded: weights of a bounded sample, and words that occur often enough
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        finder = Finder(m["first"], m["ends"], m["ordinary"], m["places"])
        for pdf in batches:
            texts, keys = pdf[text].tolist(), pdf[key].tolist()
            rows = [(k, a, b, KINDS[c], t[a:b]) for k, t, found in zip(keys, texts, label_batch(texts, m, finder), strict=True) for a, b, c in found]
            yield pd.DataFrame(rows, columns=[key, "begin", "end", "kind", "pii"])

    return spread(df.select(key, text)).mapInPandas(run, f"{key} {kind}, begin int, end int, kind string, pii string")


def redact(df: DataFrame, model: dict, text: str = "text", out: str = "redacted") -> DataFrame:
    """df with `out`: the text with [EMAIL], [PHONE], [IDENTITY], [ADDRESS] and [NAME] in place of what was found; null stays null."""
    from pyspark.sql import types as T

    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        finder = Finder(m["first"], m["ends"], m["ordinary"], m["places"])
        for pdf in batches:
            texts = pdf[text].tolist()
            new = []
            for t, found in zip(texts, label_batch(texts, m, finder), strict=True):
                parts, at = [], 0
                for a, b, c in found:
                    parts += [t[at:a], f"[{KINDS[c].upper()}]"]
                    at = b
                new.append(None if t is None else "".join(parts) + t[at:])
            yield pdf.assign(**{out: new})

    return df.mapInPandas(run, T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.StringType())]))
