"""Personal data: rule spans, and further spans chosen by gradient-boosted trees.

Native: DataFrame and SQL functions find, score and redact spans. The trees are fitted on the driver
to a bounded sample of candidates and become CASE expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The rules, in forms that match the same spans as the plain patterns but never try a run twice:
#: a match starts where its run starts or the last match ended, and repeats give nothing back.
RULES = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORD = r"[\p{L}\p{N}]"
_MAIL = r"[\p{L}\p{N}_][\p{L}\p{N}._%+'-]{0,63}+"
_AT, _DOT = r"\s?(?:@|\(at\)|\[at\]|\[@\])\s?", r"(?:\.|\s?(?:\(dot\)|\[dot\]|\[\.\])\s?)"
_LABEL = r"[\p{L}\p{N}-]{1,63}+"
_STOP, _GAP = r"(?:\.|\[\.\]|\(\.\))", r"[\x20._/-]{0,3}"
_TEL, _TEL_GAP = r"(?:\+|\(|00)?\(?", r"[\x20()./-]{0,3}"
#: Where candidates of a kind may start (a place, not a span): at every word of a local part, every part
#: of a dotted number, every group of digits.
STARTS = {
    "email": rf"(?<!{_WORD})(?={_MAIL}{_AT}{_WORD})",
    "ip": rf"(?<![0-9])(?=[0-9]{{1,3}}\x20?{_STOP})",
    "card": rf"(?<![0-9])(?=[0-9](?:{_GAP}+[0-9]){{11}})",
    "phone": rf"(?<![0-9+(])(?={_TEL}[0-9](?:{_TEL_GAP}+[0-9]){{8}})",
}
#: High-recall generators, all tried at each start, so spans of one kind may overlap: addresses plain or
#: written out, with all or one part of the domain; quads with any dots; all counts of digits that end a group.
GENERATORS = {
    "email": [rf"{_MAIL}@(?:{_LABEL}\.)+\p{{L}}{{2,24}}(?!{_WORD})", rf"{_MAIL}{_AT}{_LABEL}(?:{_DOT}{_LABEL}){{1,4}}+", rf"{_MAIL}{_AT}{_LABEL}{_DOT}{_LABEL}"],
    "ip": [rf"[0-9]{{1,3}}(?:{_STOP}[0-9]{{1,3}}){{3}}(?![0-9])", rf"[0-9]{{1,3}}(?:\x20?{_STOP}\x20?[0-9]{{1,3}}){{3}}(?![0-9])"],
    "card": [rf"[0-9](?:{_GAP}[0-9]){{{n - 1}}}(?![0-9])" for n in range(12, 20)],
    "phone": [rf"{_TEL}[0-9](?:{_TEL_GAP}[0-9]){{{n - 1}}}(?![0-9])" for n in range(9, 16)],
}
#: Characters read from a start on, and context kept before and after a span. Longer candidates are not proposed.
WINDOW, BEFORE, AFTER = 200, 24, 12
#: What a text must hold for a rule or generator to be tried.
NEEDS = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9]\x20?[.(\[]", "card": r"[0-9]", "phone": r"[0-9]"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_IP = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"
#: Words before a span that speak of such data.
CONTEXT = {
    "email": r"(?i)(?:mail|contact|kontakt|write|reach|addr)",
    "ip": r"(?i)(?:server|host|addr|\bip\b)",
    "card": r"(?i)(?:card|visa|konto|compte|cuenta|credit|pay)",
    "phone": r"(?i)(?:phone|telef|\btel|call|mobil|fax)",
}
_EMAIL = r"^[\p{L}\p{N}_%+'-][\p{L}\p{N}._%+'-]*+@(?:[\p{L}\p{N}-]++\.)++\p{L}{2,}$"
#: First digits and lengths of card numbers, and the lengths of their printed groups.
_ISSUER = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5]|2[2-7]|35)[0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12}|(?:5[0678]|6)[0-9]{10,17})$"
_GROUPS = r"^(?:[0-9]+|[0-9]{4}(?:[^0-9]{1,3}[0-9]{4}){3}(?:[^0-9]{1,3}[0-9]{3})?|[0-9]{4}[^0-9]{1,3}[0-9]{6}[^0-9]{1,3}[0-9]{4,5})$"
#: Matches whose lengths are summed at a time when positions are computed, and rule spans compared at a time.
BLOCK, NEAR = 256, 64
#: The sample: documents, training rows of a kind; the boosting: trees, step, candidate cuts of a feature; the
#: part kept for calibration, the precision that a threshold must show there, and the least probability.
SAMPLE_DOCS, SAMPLE_CANDIDATES = 20_000, 20_000
TREES, RATE, CUTS = 25, 0.3, 12
CALIBRATE, PRECISION, LEAST = 0.3, 0.98, 0.5
_SPAN = "array<struct<start:int,end:int,txt:string,before:string,after:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, txt: Column) -> Column:
    """Whether a match of a rule counts."""
    n = F.length(_digits(txt))
    if kind == "ip":
        return txt.rlike(_IP)
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(txt))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _with_places(df: DataFrame, text: str, kind: str, pattern: str, group: int) -> DataFrame:
    """df with _m (matches of pattern in column `text`), _p (the pieces between them) and _s (their starts).

    Positions are sums of the lengths of the pieces between the matches and of the matches, block by
    block, so the work stays near linear in the matches of a text.
    """
    none = F.array().cast("array<string>")
    own = "0" if group else "length(m)"  # with a group the match itself is a place between two characters
    df = df.withColumn("_m", F.when(F.col(text).rlike(NEEDS[kind]), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn("_l", F.expr(f"transform(_m, (m, i) -> named_struct('g', length(_p[i]), 'n', length(_p[i]) + {own}))"))
    df = df.withColumn(
        "_b",
        F.expr(
            f"""if(size(_l) = 0, cast(array() as array<int>), transform(sequence(0, cast((size(_l) - 1) div {BLOCK} as int)),
            j -> aggregate(slice(_l, j * {BLOCK} + 1, {BLOCK}), 0, (a, x) -> a + x.n)))"""
        ),
    )
    places = F.expr(
        f"""if(size(_b) = 0, cast(array() as array<int>), transform(_l, (x, i) -> x.g + aggregate(slice(_b, 1, cast(i div {BLOCK} as int)), 0, (a, y) -> a + y)
        + aggregate(slice(_l, cast(i div {BLOCK} as int) * {BLOCK} + 1, i % {BLOCK}), 0, (a, y) -> a + y.n)))"""
    )
    return df.withColumn("_s", places).drop("_l", "_b")


def _with_matches(df: DataFrame, out: str, kind: str, pattern: str) -> DataFrame:
    """df with `out`: all matches of pattern in _t as spans (code points, end exclusive) with context."""
    df = _with_places(df, "_t", kind, pattern, 0)
    spans = F.expr(f"transform(_s, (s, i) -> named_struct('start', s, 'end', s + length(_m[i]), 'txt', _m[i], 'before', right(_p[i], {BEFORE}), 'after', left(_p[i + 1], {AFTER})))")
    return df.withColumn(out, spans.cast(_SPAN)).drop("_m", "_p", "_s")


def _with_windows(df: DataFrame, out: str, kind: str) -> DataFrame:
    """df with `out`: for each start of the kind its place, the WINDOW characters from there and those before.

    The text is searched behind a line feed, as a split at a place before all text gives no piece.
    """
    pattern = STARTS[kind]
    df = _with_places(df.withColumn("_n", F.concat(F.lit("\n"), "_t")), "_n", kind, rf"{pattern}(?=([\s\S]{{1,{WINDOW}}}))", 1)
    before = f"""if(length(_p[i]) >= {BEFORE}, right(_p[i], {BEFORE}),
        right(array_join(transform(slice(_p, greatest(i - 10, 1), least(i + 1, 12)), x -> right(x, {BEFORE})), ''), {BEFORE}))"""
    windows = F.expr(f"transform(_s, (s, i) -> named_struct('start', s - 1, 'win', _m[i], 'before', {before}))")
    return df.withColumn(out, windows).drop("_m", "_p", "_s", "_n")


def _proposed(kind: str, w: Column) -> Column:
    """The spans that the generators of a kind propose at a start; none that may go on beyond the window."""

    def span(pattern: str) -> Column:
        txt = F.regexp_extract(w["win"], f"^(?:{pattern})", 0)
        return F.struct(w["start"].alias("start"), (w["start"] + F.length(txt)).alias("end"), txt.alias("txt"), w["before"].alias("before"), F.substring(w["win"], F.length(txt) + 1, F.lit(AFTER)).alias("after"))

    spans = F.array_distinct(F.array(*[span(p) for p in GENERATORS[kind]]))
    return F.filter(spans, lambda x: (F.length(x["txt"]) > 0) & ((F.length(x["txt"]) < F.length(w["win"])) | (F.length(w["win"]) < WINDOW)))


def _only_valid(kind: str) -> Column:
    return F.filter(f"_rule_{kind}", lambda x: _valid(kind, x["txt"]))


def with_rule_spans(documents: DataFrame) -> DataFrame:
    """documents with _t (text, null as empty) and _rule_<kind>: the valid matches of each rule."""
    df = documents.withColumn("_t", F.coalesce("text", F.lit("")))
    for kind in KINDS:
        df = _with_matches(df, f"_rule_{kind}", kind, RULES[kind])
        df = df.withColumn(f"_rule_{kind}", _only_valid(kind))
    return df


def _plain(kind: str, txt: Column) -> Column:
    """A candidate in one format for all: signs as signs, no spaces about them, numbers as digits only."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(txt, _AT, "@"), r"\s?(?:\(dot\)|\[dot\]|\[\.\])\s?", ".")
    return F.regexp_replace(txt, rf"\x20?{_STOP}\x20?", ".") if kind == "ip" else _digits(txt)


def _check(kind: str, txt: Column) -> Column:
    """Whether the plain form of a candidate can be such data at all. The trees never see this."""
    plain = _plain(kind, txt)
    if kind == "card":
        return F.when(plain.rlike(_ISSUER), _luhn(plain)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(plain).between(9, 15) & ~txt.rlike(r"^(?:19|20)[0-9]{2}[-/.][0-9]{2}[-/.]") & ~plain.rlike(r"^(.)\1*$")
    return plain.rlike(_IP if kind == "ip" else _EMAIL)


def _features(kind: str, x: Column) -> dict[str, Column]:
    """Numbers that describe the format and the context of a candidate."""
    txt, before, after = x["txt"], x["before"], x["after"]
    digits = _digits(txt)
    found = {
        "context": before.rlike(CONTEXT[kind]),
        "tight": ~txt.rlike(r"\s"),
        "written": txt.rlike(r"[\[(][@.a-z]"),
        "regular": txt.rlike(_GROUPS),
        "foreign": txt.rlike(r"^(?:\+|00[1-9])"),
        "digits": F.length(digits),
        "kinds_of_digits": F.length(F.array_join(F.array_distinct(F.split(digits, "")), "")),
        "groups": F.size(F.split(txt, r"[^\p{L}\p{N}]+")),
        "signs": F.length(F.array_join(F.array_distinct(F.split(F.regexp_replace(txt, r"[\p{L}\p{N}]", ""), "")), "")),
        "letters_at_end": F.length(F.regexp_extract(txt, r"(\p{L}*)$", 1)),
        "free_before": before.rlike(r"(?:^|[\s(\[,:;<>\"'=])$"),
        "free_after": after.rlike(r"^(?:$|[\s)\],:;<>\"'!?]|\.(?:$|\s))"),
        "more_digits": F.length(_digits(after)),
    }
    if kind == "email":  # how long an address is and what digits it has speak neither for nor against it
        found |= dict.fromkeys(("digits", "kinds_of_digits", "groups"), F.lit(0))
    return {k: v.cast("double") for k, v in found.items()}


def _formats(kind: str, x: Column) -> list[tuple[Column, Column, Column, int]]:
    """Training examples from a rule span: (txt, before, after, label). The span in other formats at the
    same place is right, also before another number; glued to a word, inside a longer number, or with a
    price for a domain it is wrong."""
    txt, before, after = x["txt"], x["before"], x["after"]
    glued = F.concat(before, F.lit("x"))
    groups = lambda sign: F.regexp_replace(_digits(txt), "([0-9]{4})(?=[0-9])", f"$1{sign}")
    at = lambda sign, dot: F.regexp_replace(F.regexp_replace(txt, r"\.(?=[^@]*$)", dot), "@", sign)
    formats = {
        "email": lambda: [at(" (at) ", " (dot) "), at("[at]", "."), at(" [at] ", "[dot]"), at(" @ ", ".")],
        "ip": lambda: [F.regexp_replace(txt, r"\.", sign) for sign in ("[.]", "(.)", " . ")],
        "card": lambda: [_digits(txt), groups("."), groups("-"), groups(" ")],
        "phone": lambda: [F.regexp_replace(txt, r"^\+", "00"), F.regexp_replace(txt, r"^\+", ""), F.regexp_replace(txt, "[() .-]+", "/"), F.concat(F.lit("+"), _digits(txt))],
    }
    other = formats[kind]()
    out = [(t, before, after, 1) for t in (txt, *other)]
    out += [(t, glued, after, 0) for t in (txt, other[0], other[-1])]
    if kind == "email":
        return [*out, *[(F.regexp_replace(txt, "@.*", price), before, after, 0) for price in (" @ 7.30", "@12.50", " @ 9.99")]]
    out += [(t, before, F.concat(F.lit(more), after), 1) for t in (txt, other[0]) for more in (" 12/27", " 314")]
    return [*out, *[(t, before, F.concat(F.lit(more), after), 0) for t in (txt, other[0]) for more in (".7", ".42")]]


def _overlapped(kind: str, c: Column) -> Column:
    """Whether a candidate overlaps a rule span. An address may hold shorter ones: it extends them.

    Spans of one rule never overlap, so those near a candidate are the last that start before its end.
    """

    def clash(k: str) -> Column:
        last = F.size(F.filter(f"_heads_{k}", lambda h: h < c["end"]))
        near = F.slice(F.col(f"_rule_{k}"), F.greatest((last - 2) * NEAR, F.lit(0)) + 1, F.lit(2 * NEAR))

        def meets(b: Column) -> Column:
            inside = (c["start"] <= b["start"]) & (b["end"] <= c["end"]) & (b["end"] - b["start"] < c["end"] - c["start"])
            meet = (b["start"] < c["end"]) & (c["start"] < b["end"])
            return meet & ~inside if k == kind == "email" else meet

        return F.exists(near, meets)

    out = clash(KINDS[0])
    for k in KINDS[1:]:
        out = out | clash(k)
    return out


def _with_heads(df: DataFrame) -> DataFrame:
    """df with _heads_<kind>: the starts of every NEAR-th rule span."""
    for k in KINDS:
        heads = F.expr(f"transform(sequence(0, cast((size(_rule_{k}) - 1) div {NEAR} as int)), b -> _rule_{k}[b * {NEAR}].start)")
        df = df.withColumn(f"_heads_{k}", F.when(F.size(f"_rule_{k}") > 0, heads).otherwise(F.array().cast("array<int>")))
    return df


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
    """A regression tree for the second-order loss: (feature, cut, low, high) or a leaf value."""
    leaf = float(-RATE * grad.sum() / (hess.sum() + 1.0))
    if not depth or len(x) < 20:
        return leaf
    gain = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + 1.0)
    best, at = gain(np.ones(len(x), bool)) + 1e-6, None
    for f in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1], method="lower")):
            low = x[:, f] <= cut
            if 5 <= low.sum() <= len(x) - 5 and (g := gain(low) + gain(~low)) > best:
                best, at = g, (f, float(cut))
    if at is None:
        return leaf
    low = x[:, at[0]] <= at[1]
    return (*at, _grow(x[low], grad[low], hess[low], depth - 1), _grow(x[~low], grad[~low], hess[~low], depth - 1))


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    low = x[:, tree[0]] <= tree[1]
    return np.where(low, _value(tree[2], x), _value(tree[3], x))


def boost(x: np.ndarray, y: np.ndarray):
    """Trees and threshold for the probability that y is 1; None where no threshold reaches PRECISION.

    The last part of the (hashed, so random) rows calibrates: the scores are rescaled by a logistic
    fit to the rows kept out, and the threshold is the least probability, LEAST or more, from which on
    PRECISION of them are right.
    """
    cut = int(len(x) * (1 - CALIBRATE))
    if min(y[:cut].sum(), cut - y[:cut].sum()) < 10 or y[cut:].sum() < 5:
        return None
    trees, score = [], np.zeros(cut)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(x[:cut], p - y[:cut], p * (1 - p), 3))
        score += _value(trees[-1], x[:cut])
    score, right = sum(_value(t, x[cut:]) for t in trees), y[cut:]
    a, b = 1.0, 0.0
    for _ in range(200):  # a slightly shrunk logistic fit of one slope and one offset
        e = 1 / (1 + np.exp(-(a * score + b))) - right
        a, b = a - 0.05 * ((e * score).mean() + 0.01 * (a - 1)), b - 0.05 * (e.mean() + 0.01 * b)
    p = 1 / (1 + np.exp(-(a * score + b)))
    for bar in np.unique(np.maximum(p[right == 1], LEAST)):
        if right[p >= bar].mean() >= PRECISION:
            return trees, a, b, float(bar)
    return None


def _examples(kind: str):
    """Functions from a rule span, and from a start, to arrays of labelled training rows."""

    def row(x: Column, label: Column) -> Column:
        known = {"kind": F.lit(KINDS.index(kind)), "label": label, "at": x["start"], **_features(kind, x)}
        return F.struct(*[v.cast("double").alias(k) for k, v in known.items()])

    def from_rule(x: Column) -> Column:
        variants = [F.struct(x["start"].alias("start"), t.alias("txt"), b.alias("before"), a.alias("after"), F.lit(y).alias("label")) for t, b, a, y in _formats(kind, x)]
        return F.transform(F.array(*variants), lambda v: row(v, v["label"]))

    def from_window(w: Column) -> Column:
        rest = F.filter(_proposed(kind, w), lambda c: ~_overlapped(kind, c))
        if kind in ("email", "phone"):
            wrong = F.filter(rest, lambda c: ~_check(kind, c["txt"]) | ~(c["before"].rlike(CONTEXT[kind]) | c["txt"].rlike(r"^\+")))
        else:
            wrong = F.filter(rest, lambda c: ~_check(kind, c["txt"]))
        return F.transform(wrong, lambda c: row(c, F.lit(0)))

    return from_rule, from_window


def fit(documents: DataFrame) -> dict:
    """A model per kind, fitted to training rows of a bounded sample of documents, read in one scan.

    The check of the plain form (Luhn, octets, domain) is held out of the features and only labels:
    rule spans are right, as they stand and in other formats at the same place (see _formats), and
    candidates that fail the check are wrong. So are, for addresses and phone numbers, which have no
    checksum, those that no rule and no word before them speaks for. All other candidates beside the
    rule spans stay without a label. A kind with fewer than about ten rows of either label gets no model.
    """
    some = shared.distinct_sample(documents.select("doc_id", "text"), ["doc_id", "text"], SAMPLE_DOCS).drop("_draw")
    df = _with_heads(with_rule_spans(some.where(F.col("text").rlike(r"[0-9@]|\(at\)|\[at\]"))))
    parts: list = []
    for kind in KINDS:
        from_rule, from_window = _examples(kind)
        df = _with_windows(df, "_w", kind)
        df = df.withColumn(f"_train_{kind}", F.concat(F.flatten(F.transform(f"_rule_{kind}", from_rule)), F.flatten(F.transform("_w", from_window)))).drop("_w")
        parts.append(f"_train_{kind}")
    # not explode: its implied filter would be pushed down and copy all of the expressions into itself
    rows = df.select("doc_id", F.explode_outer(F.concat(*parts)).alias("c")).where("c.kind is not null")
    rows = rows.select(F.xxhash64("doc_id", "c.at").alias("h"), "c.*").orderBy("h", "kind", "label", *_features("ip", F.col("c")))
    data = np.array([tuple(r)[1:] for r in rows.limit(len(KINDS) * SAMPLE_CANDIDATES).collect()], float).reshape(-1, 3 + len(_features("ip", F.col("c"))))
    mine = {kind: data[data[:, 0] == i] for i, kind in enumerate(KINDS)}
    return {kind: boost(x[:, 3:], x[:, 1]) for kind, x in mine.items() if len(x)}


def _tree_column(tree, names: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    return F.when(names[tree[0]] <= tree[1], _tree_column(tree[2], names)).otherwise(_tree_column(tree[3], names))


def _probability(kind: str, model) -> Callable[[Column], Column]:
    """The calibrated probability of a candidate."""
    trees, a, b, _ = model

    def score(x: Column) -> Column:
        names = list(_features(kind, x))
        f = F.struct(*[v.alias(k) for k, v in _features(kind, x).items()])
        total = F.transform(F.array(f), lambda f: sum((_tree_column(t, [f[k] for k in names]) for t in trees[1:]), _tree_column(trees[0], [f[k] for k in names])))[0]
        return 1 / (1 + F.exp(-(total * F.lit(float(a)) + F.lit(float(b)))))

    return score


def _best(kind: str, model) -> Callable[[Column], Column]:
    """Of the spans proposed at a start that pass the check, overlap no rule span and reach the threshold,
    the one of the highest probability (then the longest); null if there is none."""
    rank, probability, bar = KINDS.index(kind), _probability(kind, model), model[3]

    def best(w: Column) -> Column:
        spans = F.filter(F.filter(_proposed(kind, w), lambda c: ~_overlapped(kind, c)), lambda c: _check(kind, c["txt"]))
        scored = F.filter(F.transform(spans, lambda c: F.struct(c.alias("c"), probability(c).alias("p"))), lambda s: s["p"] >= F.lit(bar))
        # probabilities that agree to two places are as good as equal: then the longer span is better
        return F.array_max(F.transform(scored, lambda s: F.struct(F.round(s["p"], 2).alias("p"), s["c"]["end"].alias("end"), s["c"]["start"].alias("start"), F.lit(rank).alias("rank"))))

    return best


def with_spans(documents: DataFrame, models: dict | None = None) -> DataFrame:
    """documents (columns doc_id, text) with _t, _base and _spans: arrays of (start, rank of the kind, end) in order.

    _base holds the rule spans; _spans also those candidates that reach their threshold, overlap no
    rule span (an address may extend one) and lose against no other such candidate that they overlap
    (higher probability to two places first, then the longer span, the earlier kind, the earlier
    start). Positions are code points, ends exclusive.
    """
    models = fit(documents) if models is None else models
    df = _with_heads(with_rule_spans(documents))
    placed = lambda name, rank: F.transform(name, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))
    df = df.withColumn("_base", F.array_sort(F.concat(*[placed(f"_rule_{k}", i) for i, k in enumerate(KINDS)])))
    more = []
    for kind in KINDS:
        if not models.get(kind):
            continue
        df = _with_windows(df, "_w", kind)
        best = F.transform("_w", _best(kind, models[kind]))
        df = df.withColumn(f"_more_{kind}", F.filter(best, lambda c: c.isNotNull())).drop("_w")
        more.append(f"_more_{kind}")
    if not more:
        return df.withColumn("_spans", F.col("_base"))
    by_start = lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["p"].alias("p"))
    df = df.withColumn("_all", F.array_sort(F.transform(F.concat(*more), by_start)))

    def beaten(c: Column, i: Column) -> Column:
        # spans are shorter than WINDOW and a kind has one at a start, so rivals stand near in this order
        reach = WINDOW * len(KINDS)
        near = F.slice("_all", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach))
        place = lambda d: F.struct(-d["p"], d["start"] - d["end"], d["rank"], d["start"])
        return F.exists(near, lambda d: (d["start"] < c["end"]) & (c["start"] < d["end"]) & (place(d) < place(c)))

    won = F.filter("_all", lambda c, i: ~beaten(c, i))
    won = F.transform(won, lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end")))
    return df.withColumn("_spans", F.array_sort(F.concat("_base", won))).drop("_all")


def spans_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found(documents: DataFrame, models: dict | None = None) -> DataFrame:
    """doc_id, counts of rule spans per kind, base_sha256 and spans of every document.

    A null text counts as empty; a text without spans has empty strings. Rows are handled one by one,
    so null, repeated and clashing columns do not matter; an empty table gives no rows.
    """
    df = with_spans(documents.select("doc_id", "text"), models)
    counts = [F.size(f"_rule_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return df.select("doc_id", *counts, F.sha2(spans_text("_base").cast("binary"), 256).alias("base_sha256"), spans_text("_spans").alias("spans"))


def redact(documents: DataFrame, models: dict | None = None) -> DataFrame:
    """documents with every span replaced by its kind in brackets, and n_chars the new length.

    Overlapping spans are replaced once, by the first. Rows without spans, null texts among them, stay
    as they are; repeated rows are treated alike; columns may have any names; an empty table stays empty.
    """
    columns, row, length = documents.columns, "_row", documents.schema["n_chars"].dataType if "n_chars" in documents.columns else None
    # the row travels as one struct, so that no column name can clash with those made here
    df = with_spans(documents.select(F.struct(*columns).alias(row), "doc_id", "text"), fit(documents) if models is None else models)
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("parts"))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(done: Column, s: Column) -> Column:
        new = F.array(F.substring(F.col("_t"), done["pos"] + 1, s["start"] - done["pos"]), F.element_at(marks, s["rank"] + 1))
        parts = F.when(s["start"] >= done["pos"], F.concat(done["parts"], new)).otherwise(done["parts"])
        return F.struct(F.greatest(done["pos"], s["end"]).alias("pos"), parts.alias("parts"))

    done = F.aggregate("_spans", start, cut, lambda d: F.concat(F.array_join(d["parts"], ""), F.substring(F.col("_t"), d["pos"] + 1, F.length("_t"))))
    df = df.withColumn("text", F.when(F.size("_spans") > 0, done).otherwise(F.col("text")))
    new = {"text": F.col("text")}
    if length is not None:
        new["n_chars"] = F.when(F.size("_spans") > 0, F.length("text")).otherwise(F.col(row)["n_chars"]).cast(length)
    return df.select(*[new.get(c, F.col(row).getField(c)).alias(c) for c in columns])
