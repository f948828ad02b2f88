"""Personal data by anchors: an automaton finds at-signs, schemes, digits and cues; local parsers expand and validate what lies around."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from tracewell.llm.common import batches

#: Kinds in the order in which spans of the same start are told; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account")

_DIGITS = frozenset("0123456789")
_ALNUM = _DIGITS | frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | {"-"}
_PHONE = _DIGITS | frozenset(" ().-")
#: Ends a url.
_URL_END = frozenset(" \t\n\x0b\x0c\r\"'<>")

#: Words before an account, customer or document number, in lower case.
CUES = ("account", "acct", "konto", "kontonummer", "compte", "cuenta", "passport", "reisepass", "passeport", "pasaporte", "ssn", "iban", "tax id", "steuer-id", "customer no", "kundennummer")
#: What may lie between a cue and its number.
BETWEEN = (" number", " no.", " no", " nr.", " nr", " id", ":", "#", "=", " ", "\t")
#: Digits of a number after a cue, letters and digits it has at most.
LEAST_DIGITS, MOST_SIGNS = 6, 34


def automaton() -> ahocorasick.Automaton:
    """Anchors: at-signs, schemes, a plus before a digit, a dot between digits, neighbouring digits of a number, cues."""
    out = ahocorasick.Automaton()
    digits = sorted(_DIGITS)
    anchors = [("@", "email"), ("://", "login")]
    anchors += [(f"+{a}", "phone") for a in digits]
    anchors += [(f"{a}.{b}", "ip") for a in digits for b in digits]
    anchors += [(f"{a}{sep}{b}", "card") for a in digits for b in digits for sep in ("", " ", "-")]
    anchors += [(w, "account") for cue in CUES for w in {cue, cue.capitalize(), cue.upper()}]
    for word, kind in anchors:
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def email(text: str, at: int, least: int) -> tuple[int, int] | None:
    """The address around the at-sign ``at`` that begins at ``least`` or later."""
    begin = at
    while begin > least and text[begin - 1] in _LOCAL:
        begin -= 1
    if begin == at:
        return None
    end, labels, here = None, 0, at + 1
    while True:
        stop = here
        while stop < len(text) and text[stop] in _LABEL:
            stop += 1
        if stop == here:
            break
        labels, end, here = labels + 1, stop, stop + 1
        if stop >= len(text) or text[stop] != ".":
            break
    return (begin, end) if labels > 1 else None


def ip(text: str, dot: int) -> tuple[int, list[tuple[int, int]]]:
    """Numbers joined by single dots around the dot: where they end, and the address of each four of them in turn that is one."""
    begin = dot
    while begin > 0 and (text[begin - 1] in _DIGITS or (text[begin - 1] == "." and begin > 1 and text[begin - 2] in _DIGITS and text[begin] in _DIGITS)):
        begin -= 1
    parts, here = [], begin
    while True:
        stop = here
        while stop < len(text) and text[stop] in _DIGITS:
            stop += 1
        parts.append((here, stop))
        if stop + 1 < len(text) and text[stop] == "." and text[stop + 1] in _DIGITS:
            here = stop + 1
        else:
            break
    fours = [parts[n : n + 4] for n in range(0, len(parts) - 3, 4)]
    return parts[-1][1], [(four[0][0], four[3][1]) for four in fours if all(_byte(text[a:b]) for a, b in four)]


def _byte(number: str) -> bool:
    number = number.lstrip("0")
    return len(number) < 4 and int(number or 0) < 256


def card(text: str, at: int) -> tuple[int, tuple[int, int] | None]:
    """Digits with single blanks or hyphens between them that begin at ``at``: where they end, and they themselves if they are a card's."""
    digits, end = [text[at]], at + 1
    while end < len(text):
        if text[end] in _DIGITS:
            digits.append(text[end])
            end += 1
        elif text[end] in " -" and end + 1 < len(text) and text[end + 1] in _DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    return end, (at, end) if 12 <= len(digits) <= 19 and luhn("".join(digits)) else None


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def phone(text: str, plus: int) -> tuple[int, tuple[int, int] | None]:
    """A number after the plus: where it ends (the plus, if it is none), and it itself with 9 to 15 digits."""
    end = plus + 2
    while end < len(text) and text[end] in _PHONE:
        end += 1
    while end > plus + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end <= plus + 3:
        return plus + 1, None
    return end, (plus, end) if 9 <= sum(c in _DIGITS for c in text[plus:end]) <= 15 else None


def login(text: str, at: int) -> tuple[int, int] | None:
    """A url with a user's name or password before its host: from the scheme's first letter to the host's end."""
    begin = at
    while begin > 0 and text[begin - 1] in _ALNUM:
        begin -= 1
    end, sign = at + 3, None
    while end < len(text) and text[end] not in _URL_END and text[end] not in "/?#":
        sign = end if text[end] == "@" else sign
        end += 1
    return (begin, end) if begin < at and sign is not None and sign > at + 3 and end > sign + 1 else None


def account(text: str, end: int) -> tuple[str, int, int] | None:
    """After a cue that ends at ``end`` the number it announces: an IBAN if its check digits hold, else one of at least LEAST_DIGITS digits."""
    here, moved = end, True
    while moved and here - end < 16:
        moved = False
        for between in BETWEEN:
            if text[here : here + len(between)].lower() == between:
                here, moved = here + len(between), True
                break
    if here == end:
        return None
    stop, signs, last = here, [], here
    while stop < len(text) and len(signs) <= MOST_SIGNS:
        if text[stop] in _DIGITS or text[stop].isascii() and text[stop].isupper():
            signs.append(text[stop])
            last = stop + 1
        elif not (text[stop] in " -" and signs and stop + 1 < len(text) and text[stop + 1] in _ALNUM):
            break
        stop += 1
    if len(signs) > MOST_SIGNS or sum(c in _DIGITS for c in signs) < LEAST_DIGITS or (last < len(text) and text[last] in _ALNUM):
        return None
    return ("iban" if iban("".join(signs)) else "account", here, last)


def iban(signs: str) -> bool:
    if not (15 <= len(signs) <= 34 and signs[:2].isalpha() and signs[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in signs[4:] + signs[:4])) % 97 == 1


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal data in a text, by start, then kind; code points, ends exclusive.

    Anchors come in order, each kind keeps where its last match ended (also one that failed its
    validation), and goes on from there.
    """
    out: list[tuple[int, int, str]] = []
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, size) in anchors.iter(text):
        at = last + 1 - size
        if kind == "card":
            if at >= done["card"]:
                # a digit before it would have been an anchor already
                done["card"], found = card(text, at)
                if found:
                    out.append((*found, "card"))
        elif kind == "email":
            if at >= done["email"] and (found := email(text, at, done["email"])):
                done["email"] = found[1]
                out.append((*found, "email"))
        elif kind == "ip":
            if at + 1 >= done["ip"]:
                done["ip"], all_found = ip(text, at + 1)
                out += [(*found, "ip") for found in all_found]
        elif kind == "phone":
            if at >= done["phone"]:
                done["phone"], found = phone(text, at)
                if found:
                    out.append((*found, "phone"))
        elif kind == "login":
            if at >= done["login"] and (found := login(text, at)):
                done["login"] = found[1]
                out.append((*found, "login"))
        elif last + 1 >= done["account"] and (at == 0 or text[at - 1] not in _ALNUM) and (found := account(text, last + 1)):
            done["account"] = found[2]
            out.append((found[1], found[2], found[0]))
    rank = {k: n for n, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[0], rank[s[2]]))


def told(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def _found(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    anchors = automaton()
    for pdf in it:
        every = [spans(t, anchors) if t else [] for t in pdf["text"]]
        base = [[s for s in ss if s[2] in BASE] for ss in every]
        out = pd.DataFrame({"doc_id": pdf["doc_id"]})
        for kind in BASE:
            out[f"n_{kind}"] = [sum(s[2] == kind for s in ss) for ss in base]
        out["base_sha256"] = [hashlib.sha256(told(ss).encode()).hexdigest() for ss in base]
        out["spans"] = [told(ss) for ss in every]
        yield out


def find(docs: DataFrame) -> DataFrame:
    """Personal data of every document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The base are e-mail addresses, IPv4 addresses (also as the first four of more numbers), card
    numbers of 12 to 19 digits whose check digit holds, and phone numbers of 9 to 15 digits after a plus; of each kind the leftmost that
    don't overlap. Besides come ``login`` (a url with a name before its host), and after a cue ``iban``
    (check digits hold) and ``account`` (other numbers of six digits or more). ``spans`` has all as kind:start:end, in
    code points, by start, then kind; ``base_sha256`` digests the base in the same form.

    One pass over every whole text: an automaton of anchors leads to the places where a parser looks at what lies
    around. Nulls and empty texts have no spans; each row gives a row, repeated ones and those
    without an id too; other columns are not returned.
    """
    batches(docs.sparkSession)
    schema = "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    # ids go through Python as text, so that nulls don't make them floats
    out = docs.selectExpr("CAST(doc_id AS string) AS doc_id", "text").mapInPandas(_found, schema)
    return out.withColumn("doc_id", out["doc_id"].cast(docs.schema["doc_id"].dataType))
