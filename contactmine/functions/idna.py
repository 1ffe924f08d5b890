"""Internationalised host names after IDNA 2008 (RFC 5890-5893), as expressions.

Nothing is mapped: a host that holds a character the rules don't allow, upper case outside ASCII
among them, has no ASCII form.  Labels are tested by patterns whose character classes follow from
Unicode's properties, and encoded by Punycode (RFC 3492) as folds over their characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of RFC 3492, section 5.
BASE, TMIN, TMAX, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# Fixed values of RFC 5892, section 2.6: allowed and not allowed whatever the properties say.
ALLOWED = "ßς۽۾་〇"
DISALLOWED = "ـߺ〮〯〱〲〳〴〵〻"
# Characters that have rules of their own (RFC 5892, appendix A).
IN_CONTEXT = "·͵׳״・‌‍" + "".join(map(chr, [*range(0x660, 0x66A), *range(0x6F0, 0x6FA)]))
DOTS = r"[.。．｡]"
LABEL, HOST = 63, 253


def _stable(c: str) -> bool:
    normal = unicodedata.normalize("NFKC", c).casefold()
    return unicodedata.normalize("NFKC", normal) == c


def _may_stand(c: str) -> bool:
    if c in IN_CONTEXT or c in DISALLOWED:
        return False
    if c in ALLOWED:
        return True
    if not _stable(c) or "ᄀ" <= c <= "ᇿ" or "ꥠ" <= c <= "꥿" or "ힰ" <= c <= "퟿":
        return False  # unstable, or a letter of old Hangul
    return unicodedata.category(c) in ("Ll", "Lu", "Lo", "Nd", "Lm", "Mn", "Mc")


def _class(chars: Iterable[int]) -> str:
    """The members of a Java character class, as ranges."""
    out: list[list[int]] = []
    for c in chars:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\x{{{a:x}}}" + (rf"-\x{{{b:x}}}" if b > a else "") for a, b in out)


def _every(test: Callable[[str], bool]) -> str:
    return _class(c for c in range(128, 0x32000) if not 0xD800 <= c < 0xE000 and test(chr(c)))


def _composable() -> str:
    """Two characters that normalising would make one."""
    pairs: dict[int, list[int]] = {}
    for c in range(128, 0x12000):
        parts = unicodedata.decomposition(chr(c)).split() if not 0xD800 <= c < 0xE000 else []
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(c)) == chr(c):
            pairs.setdefault(int(parts[1], 16), []).append(int(parts[0], 16))
    return "|".join(rf"[{_class(sorted(first))}]\x{{{second:x}}}" for second, first in sorted(pairs.items()))


@lru_cache
def label_pattern() -> str:
    """Java pattern of the labels that may be encoded: characters, contexts, hyphens, order of writing directions."""
    direction = lambda *kinds: _every(lambda c: unicodedata.bidirectional(c) in kinds)
    plain, mark = rf"a-z0-9\-{_every(_may_stand)}", _every(lambda c: unicodedata.category(c)[0] == "M")
    virama = _every(lambda c: unicodedata.combining(c) == 9)
    context = "|".join([
        r"(?<=l)·(?=l)", r"͵(?=\p{IsGreek})", r"(?<=\p{IsHebrew})[׳״]", rf"(?<=[{virama}])[‌‍]",
        r"・", r"[٠-٩]", r"[۰-۹]",
    ])
    right, arabic, other, none = direction("R", "AL"), direction("AN"), direction("ES", "CS", "ET", "ON", "BN"), direction("NSM")
    european = f"0-9{direction('EN')}"
    return "".join([
        r"^(?!-)(?!..--)(?!.*-$)", rf"(?![{mark}])", rf"(?!.*(?:{_composable()}))",
        r"(?!.*・)" r"(?=.*)" if False else r"(?!(?=.*・)(?!.*[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]))",
        r"(?!(?=.*[٠-٩])(?=.*[۰-۹]))",
        rf"(?:(?!.*[{right}{arabic}])|(?=[{right}])(?=[{right}{arabic}{european}{other}{none}\-]*$)",
        rf"(?=.*[{right}{arabic}{european}][{none}]*$)(?!(?=.*[{european}])(?=.*[{arabic}])))",
        rf"(?:[{plain}]|{context})+$",
    ])


# Expressions are built as SQL text: as Columns, the folds below would take seconds to put together.


def _let(value: str, name: str, use: str) -> str:
    """``use`` with ``name`` for the value, which is computed once."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def _number(value: str, bias: str) -> str:
    """Punycode's digits of a number."""
    digit = lambda at: f"substring('{DIGITS}', {at} + 1, 1)"
    more = _let(f"{BASE} - t", "span", f"""named_struct('q', cast((x.q - t) div span AS int),
        'out', concat(x.out, {digit("(t + (x.q - t) % span)")}), 'done', false)""")
    last = f"named_struct('q', x.q, 'out', concat(x.out, {digit('x.q')}), 'done', true)"
    step = f"CASE WHEN x.done THEN x ELSE {_let(f'least({TMAX}, greatest({TMIN}, i * {BASE} - {bias}))', 't', f'CASE WHEN x.q < t THEN {last} ELSE {more} END')} END"
    return f"aggregate(sequence(1, 9), named_struct('q', {value}, 'out', '', 'done', false), (x, i) -> {step}, x -> x.out)"


def _adapted(delta: str, points: str, first: str) -> str:
    """The bias after a number."""
    span, limit = BASE - TMIN, (BASE - TMIN) * TMAX // 2
    step = f"CASE WHEN y.d > {limit} THEN named_struct('d', cast(y.d div {span} AS int), 'k', y.k + {BASE}) ELSE y END"
    start = f"named_struct('d', cast(damped + damped div {points} AS int), 'k', 0)"
    fold = f"aggregate(sequence(1, 8), {start}, (y, j) -> {step}, y -> y.k + cast({span + 1} * y.d div (y.d + {SKEW}) AS int))"
    return _let(f"cast(CASE WHEN {first} THEN {delta} div {DAMP} ELSE {delta} div 2 END AS int)", "damped", fold)


def _punycode(label: str) -> str:
    """The label's Punycode, without prefix."""
    state = lambda **parts: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in parts.items()) + ")"
    number = state(n="s.n", delta="0", bias=_adapted("s.delta", "(s.h + 1)", "s.h = s.b"), h="s.h + 1", b="s.b", out=f"concat(s.out, {_number('s.delta', 's.bias')})")
    passed = state(n="s.n", delta="s.delta + cast(c < s.n AS int)", bias="s.bias", h="s.h", b="s.b", out="s.out")
    moved = state(n="m", delta="r.delta + (m - r.n) * (r.h + 1)", bias="r.bias", h="r.h", b="r.b", out="r.out")
    one = f"aggregate(codes, {moved}, (s, c) -> CASE WHEN c = s.n THEN {number} ELSE {passed} END)"
    after = _let(one, "d", state(n="d.n + 1", delta="d.delta + 1", bias="d.bias", h="d.h", b="d.b", out="d.out"))
    basic, plain = f"size(filter(codes, c -> c < {FIRST}))", rf"regexp_replace({label}, r'[^\x00-\x7f]', '')"
    start = state(n=FIRST, delta="0", bias=BIAS, h=basic, b=basic, out=f"concat({plain}, CASE WHEN {plain} = '' THEN '' ELSE '-' END)")
    fold = f"aggregate(array_sort(array_distinct(filter(codes, c -> c >= {FIRST}))), {start}, (r, m) -> {after}, r -> r.out)"
    return _let(f"transform(split({label}, ''), c -> ascii(c))", "codes", fold)


@lru_cache
def _ascii_form() -> str:
    ascii_label = r"^(?i:xn--[a-z0-9-]+|(?!-)(?!..--)(?!.*-$)[a-z0-9-]+)$"
    coded = rf"""CASE WHEN p RLIKE r'^[\x00-\x7f]*$' THEN CASE WHEN p RLIKE r'{ascii_label}' THEN p END
        WHEN p RLIKE r'{label_pattern()}' THEN concat('xn--', {_punycode("p")}) END"""
    label = _let(coded, "a", f"CASE WHEN length(a) <= {LABEL} THEN a END")
    joined = f"concat(array_join(transform(ended, p -> {label}), '.', '?'), CASE WHEN size(ended) < size(parts) THEN '.' ELSE '' END)"
    made = _let(joined, "made", f"CASE WHEN NOT contains(made, '?') AND length(rtrim('.', made)) <= {HOST} THEN made END")
    # one dot may end a host
    ended = _let("CASE WHEN size(parts) > 1 AND element_at(parts, -1) = '' THEN slice(parts, 1, size(parts) - 1) ELSE parts END", "ended", made)
    return _let(rf"split(host, r'{DOTS}')", "parts", ended)


def to_ascii(host: Column) -> Column:
    """The host in ASCII; null where the rules give it no ASCII form."""
    return F.get(F.call_function("transform", F.array(host), F.expr(f"host -> {_ascii_form()}")), 0)
