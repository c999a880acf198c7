"""Personal data by weak supervision, in DataFrame functions only.

Base spans (email, ip, card, phone) come from fixed patterns and checks. Further candidates (credentials,
identity numbers, account numbers, national phone numbers, disguised addresses, names) come from wider
patterns. Six labelers vote on each: a regex on its form, a gazetteer of words and beginnings, words before it
that speak for private data and words that speak against, the variety of its characters, and whether it is
assigned to something or stands in running text. Counts of candidates by kind, votes and features (a table whose
size the numbers of kinds, votes and feature values bound) go to the driver. For each kind,
expectation-maximisation over the patterns of votes estimates how reliable each labeler is and how likely each
pattern is private; these are the soft labels of a logistic classifier that sees the votes and, beyond them, the
candidate's length and characters, what stands right before and after it, and the word before. Candidates that
it accepts and that touch no base span are added. Texts are read once, in the JVM: spans and candidates are
written to a table that both the counts and the classifier read.

Positions count code points, ends exclusive. Null text counts as empty: no spans. Repeated rows each get
their own result. Extra columns pass through; columns named like the added ones are replaced. For kinds without
a candidate the classifier falls back on the labelers' prior reliabilities.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns; those for cards carry the limits of digits, so that only runs of 13 to 19 digits leave the regex.
#: Look-behinds and possessive quantifiers keep the leftmost matches of the plain patterns but make every scan linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

#: Kinds of candidates beyond the base ones. A pattern only says what may be private; whether it is, the labelers say.
WIDE = {
    "secret": r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])[A-Za-z0-9_/+-]{16,}+=*(?![A-Za-z0-9_/+=-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+(.-])(?<![0-9).-] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "name": r"(?<![\p{L}])(?!(?:Dear|Mr|Mrs|Ms|Name|Contact|Patient|Regards|The) )[A-Z][a-z]{1,20}+ [A-Z][a-z]{2,20}+(?![\p{L}])",
}
#: What a text must hold before a pattern is tried on it.
GUARDS = {"masked_email": r"[\[(](?:at|AT)[\])]", "name": r"[A-Z][a-z]++ [A-Z][a-z]"}
#: The form labeler: what speaks for a candidate of the kind by its characters alone, and what against it.
FORM = {
    "secret": (r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).{20,}$|^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$", r"^[0-9-]+$|/.*/|^[a-z]+-[a-z-]+[0-9]+$"),
    "national_id": (r"^[0-8]", r"^(?:000|666|9[0-9]{2})|-00-|-0000$"),
    "account": (r" ", r"^[A-F0-9]+$"),
    "local_phone": (r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]", r"^\(?[01]"),
    "masked_email": (r"[a-z]", r"^[0-9. -]+"),
    "name": (r"^$", r"^([A-Za-z]+) \1$|(?:License|Licence|Version|Public|Foundation|Software)$"),
}
#: The gazetteer labeler: lists of words and beginnings known for the kind.
KNOWN = {
    "secret": r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk[_-]|pk[_-]|xox[abprs]-|eyJ)",
    "account": r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|RO|SE)",
    "masked_email": r"(?i)(?:com|org|net|edu|de|fr|es|uk|io|info)$",
    "name": r"^(?:Alice|Anna|Carlos|Charles|Claire|David|Elena|Emily|Emma|Hans|Ines|James|Jean|John|Juan|Julia|Karl|Laura|Linda|Luis|Maria|Marie|Mary|Michael|Paul|Peter|Pierre|Robert|Sarah|Sofia|Susan|Thomas|William) ",
}
#: The context labelers: words in the 32 code points before a span that speak for private data of the kind, and words that speak against any.
CUES = {
    "secret": r"(?i)(?:token|secret|passw|api.?key|access.?key|credential|bearer|auth)",
    "national_id": r"(?i)(?:ssn|social|identity|id no|national|tax)",
    "account": r"(?i)(?:iban|account|bank|konto|compte|cuenta)",
    "local_phone": r"(?i)(?:phone|call|tel|mobile|fax|contact)",
    "masked_email": r"(?i)(?:mail|contact|write|reach)",
    "name": r"(?i)(?:\bname\b|\bmrs?\b|\bms\b|\bdear\b|contact|patient|signed|regards)",
}
AGAINST = r"(?i)(?:sha-?[0-9]|md5|commit|checksum|digest|integrity|build|revision|isbn|issn|doi|version|figure|page|order|https?:|www\.|src|href|base64)"
LABELERS = ("form", "gazetteer", "cue", "against", "spread", "assigned")
#: Before any data: the share of private candidates; the weight of the prior in candidates, and its least share of a kind's candidates.
PRIOR, LEAST_PRIOR, PRIOR_SHARE = 0.3, 20.0, 0.1
_BLOCK = 256  # matches whose positions are summed up in one fold


def _text(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str, guard: str) -> str:
    """SQL: the matches of pattern in text as array<struct<s,e,t>>. split() gives what lies between the matches that
    regexp_extract_all() gives; positions are sums over both. Folds copy what they have built, so they run over blocks
    of matches, then over the blocks."""
    p = _text(pattern)
    item, none = "struct<s:int,e:int,t:string>", "cast(array() as array<{}>)"
    within = (
        f"aggregate(b, named_struct('at', 0, 'out', {none.format(item)}), (acc, x) -> named_struct('at', acc.at + x.a + coalesce(length(x.t), 0),"
        " 'out', if(x.t is null, acc.out, concat(acc.out, array(named_struct('s', acc.at + x.a, 'e', acc.at + x.a + length(x.t), 't', x.t))))))"
    )
    blocks = f"transform(sequence(0, (size(z) - 1) div {_BLOCK}), i -> slice(z, i * {_BLOCK} + 1, {_BLOCK}))"
    placed = (
        f"aggregate(transform({blocks}, b -> {within}), named_struct('at', 0, 'out', {none.format(f'array<{item}>')}), (acc, b) -> named_struct('at', acc.at + b.at,"
        " 'out', concat(acc.out, array(transform(b.out, x -> named_struct('s', acc.at + x.s, 'e', acc.at + x.e, 't', x.t))))), acc -> flatten(acc.out))"
    )
    zipped = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g, h) -> struct(length(g) as a, h as t))"
    return f"if({guard}, element_at(transform(array({zipped}), z -> {placed}), 1), {none.format(item)})"


def _digits(t: str) -> str:
    return f"translate({t}, ' +().-', '')"


def _luhn(t: str) -> str:
    d = f"reverse({_digits(t)})"
    return (
        f"aggregate(sequence(1, length({d})), 0, (n, i) -> n + case when i % 2 = 1 then cast(substring({d}, i, 1) as int)"
        f" when cast(substring({d}, i, 1) as int) > 4 then 2 * cast(substring({d}, i, 1) as int) - 9 else 2 * cast(substring({d}, i, 1) as int) end) % 10 = 0"
    )


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _email, _ip, _card, _phone: arrays of struct<s,e,t>, in order."""
    t = f"coalesce(`{text}`, '')"
    digit = f"{t} rlike '[0-9]'"
    return docs.withColumns(
        {
            "_email": F.expr(_matches(t, EMAIL, f"contains({t}, '@')")),
            "_ip": F.expr(f"filter({_matches(t, IP, digit)}, x -> forall(split(x.t, '[.]'), p -> cast(p as double) <= 255))"),
            "_card": F.expr(f"filter({_matches(t, CARD, digit)}, x -> {_luhn('x.t')})"),
            "_phone": F.expr(f"filter({_matches(t, PHONE, f'contains({t}, {chr(39)}+{chr(39)})')}, x -> length({_digits('x.t')}) between 9 and 15)"),
        }
    )


def _votes(kind: str, x: str) -> dict[str, str]:
    """SQL of the labelers' votes on candidate x of a kind: 1 for private, -1 against, 0 for none. Each looks at something else."""
    speaks, denies = FORM[kind]
    # of long tokens (any length) without an array of their characters
    letters = f"aggregate(split('abcdefghijklmnopqrstuvwxyz0123456789_/+-=', ''), 0, (n, c) -> n + cast(contains(lower({x}.t), c) as int))"
    return {
        "form": f"case when {x}.t rlike {_text(denies)} then -1 when {x}.t rlike {_text(speaks)} then 1 else 0 end",
        "gazetteer": f"if({x}.t rlike {_text(KNOWN[kind])}, 1, 0)" if kind in KNOWN else "0",
        "cue": f"if({x}.b rlike {_text(CUES[kind])}, 1, 0)",
        "against": f"if({x}.b rlike {_text(AGAINST)}, -1, 0)",
        "spread": f"case when {letters} <= 4 then -1 when {letters} >= 10 then 1 else 0 end" if kind == "secret" else "0",
        "assigned": f"if({x}.b rlike {_text('[:=][ ]?[^A-Za-z0-9 ]?$')}, 1, if({x}.b rlike {_text('[A-Za-z0-9][ ]$')}, -1, 0))",
    }


def _class_of(c: str) -> str:
    """SQL: the sort of character c."""
    return f"case when {c} = '' then 'edge' when {c} rlike '[A-Za-z]' then 'letter' when {c} rlike '[0-9]' then 'digit' when {c} = ' ' then 'space' when {c} in ('\"', '`', chr(39)) then 'quote' when {c} rlike '[=:]' then 'sign' else 'other' end"


def _features(kind: str, x: str) -> str:
    """SQL: what the classifier sees of candidate x besides the votes: length, characters, what stands right before and after it, and the word before (a hash, 32 values)."""
    size = f"case when length({x}.t) < 12 then 's' when length({x}.t) < 24 then 'm' when length({x}.t) < 48 then 'l' else 'x' end"
    made = f"case when {x}.t rlike '^[0-9 .()-]+$' then 'digits' when {x}.t rlike '^(?:[0-9a-f]+|[0-9A-F]+)$' then 'hex' when {x}.t rlike '^[A-Za-z ]+$' then 'letters' when {x}.t rlike '[a-z]' and {x}.t rlike '[A-Z]' then 'mixed' else 'plain' end"
    word = f"pmod(xxhash64(lower(regexp_extract({x}.b, {_text('([A-Za-z]+)[^A-Za-z]*$')}, 1))), 32)"
    return f"concat('size=', {size}), concat('made=', {made}), concat('before=', {_class_of(f'right({x}.b, 1)')}), concat('after=', {_class_of(f'{x}.a')}), concat('word=', {word})"


def _candidates(text: str) -> str:
    """SQL: all candidates as array<struct<k,s,e,f>>: kind, span, and features as text, the votes (form=1, …) first."""
    t = f"coalesce(`{text}`, '')"
    parts = []
    for k, p in WIDE.items():
        found = f"transform({_matches(t, p, f'{t} rlike {_text(GUARDS.get(k, '[0-9]'))}')}, x -> named_struct('s', x.s, 'e', x.e, 't', x.t, 'b', substring({t}, greatest(x.s - 31, 1), least(x.s, 32)), 'a', substring({t}, x.e + 1, 1)))"
        votes = ", ".join(f"concat('{name}=', {sql})" for name, sql in _votes(k, "x").items())
        parts.append(f"transform({found}, x -> named_struct('k', '{k}', 's', x.s, 'e', x.e, 'f', array({votes}, {_features(k, 'x')})))")
    return f"concat({', '.join(parts)})"


@dataclass
class Model:
    """Weights of the span classifier: for each kind a bias (feature '') and the weights of features such as cue=1 or made=hex; reliabilities[kind][labeler][vote]: its chance given private, and given not private."""

    weights: dict[str, dict[str, float]]
    reliabilities: dict[str, dict[str, dict[int, tuple[float, float]]]]


def _prior_table() -> dict[str, dict[int, tuple[float, float]]]:
    return {name: {1: (0.55, 0.15), 0: (0.35, 0.55), -1: (0.1, 0.3)} for name in LABELERS}


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def reliabilities_of(votes: dict[tuple[int, ...], float], rounds: int = 100) -> tuple[dict[str, dict[int, tuple[float, float]]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation for one kind: how often each labeler casts each vote given private and not, and how likely each pattern of votes is private.

    Labelers count as independent given the truth. The prior table stands for LEAST_PRIOR candidates, or for PRIOR_SHARE
    of them if that is more: labelers are taken to be better than chance until the data say otherwise. A candidate that no labeler votes for counts as not private."""
    table, share, total = _prior_table(), PRIOR, sum(votes.values())
    strength = max(LEAST_PRIOR, PRIOR_SHARE * total)
    private: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        # what no labeler votes for is not private
        private = {v: max(v) > 0 and _sigmoid(math.log(share / (1 - share)) + sum(math.log(table[n][x][0] / table[n][x][1]) for n, x in zip(LABELERS, v, strict=True))) for v in votes}
        sums = {n: {x: [strength * PRIOR * p, strength * (1 - PRIOR) * q] for x, (p, q) in prior.items()} for n, prior in _prior_table().items()}
        for v, n in votes.items():
            for name, x in zip(LABELERS, v, strict=True):
                sums[name][x][0] += private[v] * n
                sums[name][x][1] += (1 - private[v]) * n
        table = {n: {x: (a / sum(y[0] for y in s.values()), b / sum(y[1] for y in s.values())) for x, (a, b) in s.items()} for n, s in sums.items()}
        share = min(max((strength * PRIOR + sum(private[v] * n for v, n in votes.items())) / (strength + total), 0.001), 0.999)
    return table, private


def _fitted(rows: list[tuple[list[str], float, float]], steps: int = 400, ridge: float = 1e-3) -> dict[str, float]:
    """Logistic regression of soft labels (features, label, weight); the bias is the weight of ''."""
    total = sum(w for *_, w in rows)
    weights = dict.fromkeys(sorted({f for features, *_ in rows for f in features} | {""}), 0.0)
    for _ in range(steps):
        grad = {f: ridge * w for f, w in weights.items()}
        for features, label, n in rows:
            d = n / total * (_sigmoid(weights[""] + sum(weights[f] for f in features)) - label)
            for f in (*features, ""):
                grad[f] += d
        weights = {f: w - grad[f] for f, w in weights.items()}
    return weights


def estimate(counts: list[tuple[str, tuple[str, ...], int]]) -> Model:
    """From (kind, features, count): reliabilities by EM, then for each kind a classifier of the soft labels that sees votes and features. A kind without candidates falls back on the prior's votes."""
    prior = _prior_table()
    weights, tables = {}, {}
    for kind in WIDE:
        mine = [(f[: len(LABELERS)], f, n) for k, f, n in counts if k == kind]
        vote = lambda names: tuple(int(x.partition("=")[2]) for x in names)
        patterns: dict[tuple[int, ...], float] = {}
        for names, _, n in mine:
            patterns[vote(names)] = patterns.get(vote(names), 0) + n
        tables[kind], private = reliabilities_of(patterns) if mine else (prior, {})
        fallback = {f"{n}={v}": math.log(p / q) for n in LABELERS for v, (p, q) in prior[n].items()}
        weights[kind] = _fitted([(list(f), private[vote(names)], n) for names, f, n in mine]) if mine else fallback | {"": math.log(PRIOR / (1 - PRIOR))}
    return Model(weights, tables)


_WORK = {"_email", "_ip", "_card", "_phone", "_candidates"}


def prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _email, _ip, _card, _phone (base_spans()) and _candidates, in one pass over the texts; materialize it, for it is read twice."""
    return base_spans(docs, text).withColumn("_candidates", F.expr(_candidates(text)))


def fit(ready: DataFrame) -> Model:
    """ready: of prepared(). Counts candidates by kind and features, a table whose size doesn't depend on the number of documents, then estimate()."""
    rows = ready.select(F.explode("_candidates").alias("c")).groupBy("c.k", "c.f").count().collect()
    return estimate(sorted((r.k, tuple(r.f), r["count"]) for r in rows))


def found(ready: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """ready with _added: array<struct<k,s,e>>, the candidates that the classifier accepts and that touch no base span."""
    weights = "map(" + ", ".join(f"'{k}', map({', '.join(f'{_text(f)}, {w!r}D' for f, w in sorted(of.items()))})" for k, of in sorted(model.weights.items())) + ")"
    # a feature never seen says nothing
    z = f"aggregate(concat(x.f, array('')), 0D, (z, f) -> z + coalesce(try_element_at(try_element_at({weights}, x.k), f), 0D))"
    free = "not exists(concat(_email, _ip, _card, _phone), y -> y.s < x.e and x.s < y.e)"
    cut = math.log(threshold / (1 - threshold))
    return ready.withColumn("_added", F.expr(f"array_sort(transform(filter(_candidates, x -> {z} >= {cut!r}D and {free}), x -> named_struct('k', x.k, 's', x.s, 'e', x.e)))"))


def _joined(parts: list[tuple[str, str]]) -> Column:
    return F.expr("array_join(concat(" + ", ".join(f"transform({col}, x -> concat_ws(':', {kind}, x.s, x.e))" for col, kind in parts) + "), ',')")


def spans(ready: DataFrame, model: Model) -> DataFrame:
    """ready without its working columns, with n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (base and added)."""
    base = [(f"_{k}", f"'{k}'") for k in BASE]
    made = {f"n_{k}": F.size(f"_{k}").cast("long") for k in BASE} | {"base_sha256": F.sha2(_joined(base), 256), "spans": _joined([*base, ("_added", "x.k")])}
    return found(ready.drop("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"), model).withColumns(made).drop(*_WORK, "_added")


def redacted(ready: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """ready without its working columns, each span (overlapping ones merged) replaced by its kind in angle brackets; null texts stay null."""
    all_spans = "concat(" + ", ".join(f"transform(_{k}, x -> named_struct('s', x.s, 'e', x.e, 'k', '{k}'))" for k in BASE) + ", transform(_added, x -> named_struct('s', x.s, 'e', x.e, 'k', x.k)))"
    merged = (
        f"aggregate(array_sort({all_spans}), cast(array() as array<struct<s:int,e:int,k:string>>), (acc, x) -> if(size(acc) > 0 and element_at(acc, -1).e > x.s,"
        " concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', greatest(element_at(acc, -1).e, x.e), 'k', element_at(acc, -1).k))), concat(acc, array(x))))"
    )
    t = f"`{text}`"
    pieces = f"transform(_merged, (x, i) -> concat(substring({t}, if(i = 0, 0, _merged[i - 1].e) + 1, x.s - if(i = 0, 0, _merged[i - 1].e)), '<', upper(x.k), '>'))"
    done = f"if(size(_merged) = 0, {t}, concat(array_join({pieces}, ''), substring({t}, element_at(_merged, -1).e + 1)))"
    kept = [c for c in ready.columns if c not in _WORK]
    return found(ready, model).withColumn("_merged", F.expr(merged)).withColumn(text, F.expr(done)).select(*kept)
