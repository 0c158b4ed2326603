"""Languages of documents and of their segments: text likelihoods of lines fused with declared, suffix and host evidence."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.operators.joins import settled
from panelforge.session import cut_lineage, ship_package

#: Most labelled texts the line model is fitted on; more are cut to those of the smallest hash.
MAX_SAMPLES = 5_000
#: Most documents whose label and file suffix agree that the line model is fitted on besides; more are cut to those of the smallest hash.
MAX_AGREED = 3_000
#: Characters that a text the line model is fitted on may have, so that what reaches the driver is bounded in bytes; longer ones aren't learned from.
MAX_TRAINING_CHARS = 50_000
#: Most languages; they are a vocabulary, so vectors over them are small.
MAX_LANGS = 200
#: Lines (blank ones not counted) from which a run is a segment.
MIN_LINES = 5
#: A line that holds this many ends or blocks of statements, and blanks below this share, is minified text, a segment by itself.
MINIFIED_STATEMENTS, MINIFIED_BLANKS = 20, 0.08
#: Nats that one line may say for or against a language, what a change of language costs, and the weight of comment lines.
LINE_CAP, SWITCH, COMMENT_WEIGHT = 10.0, 10.0, 0.02
#: Nats for the language that a code fence names.
FENCE_BONUS = 6.0
#: Nats a line must say against its document's agreed label before it is left out of the fit.
LABEL_HOLD = 5.0
SMOOTH = 1.0
#: Tokens whose weights are gathered at once, and tokens that a worker remembers.
BLOCK_TOKENS, CACHED_TOKENS = 250_000, 300_000

_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]{1,2}|\d+|_")
_COMMENT = re.compile(r'\s*(?://|/\*|\*(?:\s|/|$)|#\s|--\s|<!--|"""[^"]*"""\s*$)')
_INLINE = re.compile(r"/\*.*?\*/|\s(?://|#|--)\s.*$")
_FENCE = re.compile(r"\s*(?:```|~~~)\s*([\w+#.-]*)\s*$")
_OTHER = ((0x3040, 0x30FF, "<kana>"), (0x4E00, 0x9FFF, "<han>"), (0x0400, 0x04FF, "<cyrillic>"), (0xAC00, 0xD7AF, "<hangul>"), (0x0600, 0x06FF, "<arabic>"))


def script_of(word: str) -> str | None:
    """A stand-in for words of scripts other than Latin."""
    for c in word:
        o = ord(c)
        if o >= 0x0400:
            for lo, hi, name in _OTHER:
                if lo <= o <= hi:
                    return name
    return None


def line_tokens(line: str) -> list[str]:
    """Tokens of a line without inline comments, with marks for the first and last of several."""
    found = _TOKEN.findall(_INLINE.sub("", line) if ("/*" in line or "//" in line or "#" in line or "--" in line) else line)
    if len(found) > 1:
        indent = "<tab>" if line[0] == "\t" else "<in>" if line[0] == " " else "<out>"
        found.append("^" + indent + found[0])
        found.append(found[-2] + "$")
    return found


def is_comment(line: str) -> bool:
    """Whether nothing but a comment stands on the line; a block comment before code (a banner of minified text) doesn't count."""
    if not _COMMENT.match(line):
        return False
    end = line.rfind("*/")
    return end < 0 or not line[end + 2 :].strip()


def is_minified(line: str) -> bool:
    """Whether many statements stand on the line with hardly a blank between them."""
    return line.count(";") + line.count("{") + line.count("}") >= MINIFIED_STATEMENTS and line.count(" ") < MINIFIED_BLANKS * len(line)


class LineModel:
    """Naive Bayes over the tokens of a line. ``weights`` (tokens, languages) are log likelihoods relative to their mean; row 0 is for unknown tokens."""

    def __init__(self, langs: list[str], names: dict[str, str], vocab: dict[str, int], weights: np.ndarray):
        self.langs, self.names, self.vocab, self.weights = langs, names, vocab, weights

    @classmethod
    def fit(cls, samples: list[tuple[str, str]], langs: list[str], names: dict[str, str]) -> LineModel:
        """From (language, text) pairs. Tokens of fewer than three texts, or one in 500, say nothing: they are mostly names."""
        return _Training(samples, langs, names).fit()


class _Training:
    """Labelled texts as numbered lines and tokens, tokenised once however often a model is fitted on them."""

    def __init__(self, samples: list[tuple[str, str]], langs: list[str], names: dict[str, str]):
        self.langs, self.names = langs, names
        where = {c: i for i, c in enumerate(langs)}
        known = [(where[c], t) for c, t in samples if c in where and t]
        numbered, tokens = _Numbered(), _Numbered()
        self.label = np.array([c for c, _ in known], np.int64)
        self.docs = [np.array([numbered[x] for x in _lines(t)], np.int64) for _, t in known]
        lines = list(numbered)
        self.comment = np.array([is_comment(x) for x in lines], bool)
        self.long = np.array([is_minified(x) for x in lines], bool)
        flat, ends, size = [], [], 0
        for x in lines:
            ids = [tokens[t] for t in line_tokens(x)]
            flat.append(ids)
            size += len(ids)
            ends.append(size)
        self.tokens = list(tokens)
        self.flat = np.array([i for ids in flat for i in ids], np.int64)
        self.starts = np.r_[0, ends[:-1]].astype(np.int64) if ends else np.zeros(0, np.int64)
        self.ends = np.array(ends, np.int64)
        # once a line, else minified text would outweigh the rest; a word of another script also counts for its script
        script = {i: s for i, t in enumerate(self.tokens) if (s := script_of(t))}
        extra = {s: len(self.tokens) + k for k, s in enumerate(sorted(set(script.values())))}
        self.tokens += sorted(extra)
        once = [list(dict.fromkeys(ids + [extra[script[i]] for i in ids if i in script])) for ids in flat]
        self.once = np.array([i for ids in once for i in ids], np.int64)
        self.line_of = np.repeat(np.arange(len(lines)), [len(x) for x in once])
        texts = np.zeros(len(self.tokens), np.int64)
        for d in self.docs:
            seen = [once[i] for i in dict.fromkeys(d.tolist()) if not self.comment[i]]
            texts[list({i for ids in seen for i in ids})] += 1
        self.kept = np.flatnonzero(texts >= max(3, len(self.docs) // 500))
        self.kept = self.kept[np.argsort([self.tokens[i] for i in self.kept])] if len(self.kept) else self.kept

    def fit(self, keep: list[np.ndarray] | None = None) -> LineModel:
        """``keep``: for each document, which of its lines to learn from."""
        n_lines, k = len(self.comment), len(self.langs)
        weight = np.zeros((n_lines, k))
        for i, (d, c) in enumerate(zip(self.docs, self.label)):
            np.add.at(weight, (d if keep is None else d[keep[i]], c), 1.0)
        weight[self.comment] = 0.0
        counts = np.stack([np.bincount(self.once, weight[self.line_of, j], len(self.tokens)) for j in range(k)], 1) if len(self.once) else np.zeros((len(self.tokens), k))
        total = counts.sum(0)
        logp = np.log(counts[self.kept] + SMOOTH) - np.log(total + SMOOTH * (len(self.kept) + 1))
        weights = np.zeros((len(self.kept) + 1, k), np.float32)
        weights[1:] = np.clip(logp - logp.mean(1, keepdims=True), -6, 6)
        return LineModel(self.langs, self.names, {self.tokens[i]: n for n, i in enumerate(self.kept, 1)}, weights)

    def scores(self, model: LineModel) -> list[np.ndarray]:
        index = _Index(model.vocab)
        row = np.array([index[t] for t in self.tokens], np.int64) if self.tokens else np.zeros(0, np.int64)
        table = _summed(row[self.flat], self.ends, self.comment, self.long, model)
        return [table[d] for d in self.docs]


class _Index(dict):
    """Token to row of the weights; words not in the vocabulary go by their script, else to row 0."""

    def __missing__(self, token: str) -> int:
        s = script_of(token)
        i = self.get(s, 0) if s else 0
        if len(self) < CACHED_TOKENS:
            self[token] = i
        return i


class _Numbered(dict):
    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


def line_scores(lines: list[str], model: LineModel, index: _Index) -> np.ndarray:
    """Evidence of each line for each language: at most 0 (its best language), at least minus the cap; scaled down for comments."""
    flat: list[int] = []
    ends = np.empty(len(lines), np.int64)
    get = index.__getitem__
    for i, line in enumerate(lines):
        flat += map(get, line_tokens(line))
        ends[i] = len(flat)
    comment = np.array([is_comment(x) for x in lines], bool)
    return _summed(np.array(flat, np.int64), ends, comment, np.array([is_minified(x) for x in lines], bool), model)


def _summed(at: np.ndarray, ends: np.ndarray, comment: np.ndarray, long: np.ndarray, model: LineModel) -> np.ndarray:
    """Token weights summed by line, relative to the line's best language, capped and scaled."""
    sums = np.zeros((len(ends), len(model.langs)), np.float32)
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    rows = np.flatnonzero(ends > starts)
    stops = ends[rows]
    lo = 0
    while lo < len(rows):  # in blocks, so that the gathered weights stay small
        hi = max(lo + 1, int(np.searchsorted(stops, starts[rows[lo]] + BLOCK_TOKENS, side="right")))
        block = rows[lo:hi]
        a, b = starts[block[0]], ends[block[-1]]
        sums[block] = np.add.reduceat(model.weights[at[a:b]], starts[block] - a, axis=0)
        lo = hi
    cap = np.where(long, LINE_CAP * MIN_LINES, LINE_CAP).astype(np.float32)
    rel = sums - sums.max(1, keepdims=True) if sums.size else sums
    return np.maximum(rel, -cap[:, None]) * np.where(comment, COMMENT_WEIGHT, 1.0).astype(np.float32)[:, None]


def best_paths(scores: list[np.ndarray], prior: np.ndarray | None = None) -> list[np.ndarray]:
    """The likeliest language of every line of every document when each change costs SWITCH; documents of like length run together."""
    out: list[np.ndarray] = [None] * len(scores)  # type: ignore[list-item]
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    i = 0
    while i < len(order) and len(scores[order[i]]):
        longest = len(scores[order[i]])
        width = max(1, 400_000 // longest)
        chosen = [d for d in order[i : i + width] if len(scores[d]) * 2 >= longest]
        i += len(chosen)
        s, k = len(chosen), scores[chosen[0]].shape[1]
        pad = np.zeros((longest, s, k), np.float32)
        sizes = np.array([len(scores[d]) for d in chosen])
        for j, d in enumerate(chosen):
            pad[: sizes[j], j] = scores[d]
        back = np.empty((longest, s, k), bool)
        best = np.empty((longest, s), np.int16)
        dp = pad[0].copy()
        for t in range(1, longest):
            top = dp.argmax(1)
            best[t] = top
            alt = dp[np.arange(s), top] - SWITCH
            back[t] = alt[:, None] > dp
            live = (t < sizes)[:, None]
            dp = np.where(live, np.where(back[t], alt[:, None], dp) + pad[t], dp)
        state = dp.argmax(1)
        path = np.empty((longest, s), np.int16)
        for t in range(longest - 1, -1, -1):
            live = t < sizes
            path[t] = state
            if t:
                jump = back[t, np.arange(s), state] & live
                state = np.where(jump, best[t], state)
        for j, d in enumerate(chosen):
            out[d] = path[: sizes[j], j].copy()
    return [np.empty(0, np.int16) if p is None else p for p in out]


def segments(path: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Runs (start, stop) that hold MIN_LINES lines or more; a shorter run between others is a quote and belongs to what surrounds it.

    ``size``: lines that each line counts for (minified text counts as a whole segment, a fence as none).
    """
    runs = np.flatnonzero(np.r_[True, path[1:] != path[:-1]]) if len(path) else np.empty(0, int)
    stops = np.r_[runs[1:], len(path)] if len(path) else runs
    kept: list[tuple[int, int]] = []
    for a, b in zip(runs.tolist(), stops.tolist()):
        if size[a:b].sum() >= MIN_LINES:
            if kept and path[kept[-1][0]] == path[a]:
                kept[-1] = (kept[-1][0], b)
            else:
                kept.append((a, b))
    return kept


def _segment_batches(broadcast, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LineModel = broadcast.value
        index = _Index(model.vocab)
        k = len(model.langs)
        where = {c: i for i, c in enumerate(model.langs)}
        for b in batches:
            numbered = _Numbered()
            number = numbered.__getitem__
            docs = [np.array(list(map(number, t.lstrip("\ufeff").splitlines())), np.int64) if t else np.zeros(0, np.int64) for t in b.column(1).to_pylist()]
            lines = list(numbered)
            table = line_scores(lines, model, index) if lines else np.zeros((0, k), np.float32)
            # a line counts as one, minified text as a whole segment, a blank line and a fence as none
            counts = np.array([0 if not x or x.isspace() else MIN_LINES if is_minified(x) else 1 for x in lines], np.int64)
            fences = {}
            for i, x in enumerate(lines):
                if ("```" in x or "~~~" in x) and (m := _FENCE.match(x)):
                    fences[i] = where.get(model.names.get(m[1].lower(), ""), -1)
                    counts[i] = 0
            fenced = np.zeros(len(lines), bool)
            fenced[list(fences)] = True
            scores, sizes = [], []
            for ids in docs:
                weight = counts[ids]
                kept = weight > 0
                own = ids[kept]
                s = table[own]
                if len(fences) and fenced[ids].any():
                    after = np.cumsum(kept)  # position of the next line that counts
                    for at in np.flatnonzero(fenced[ids]):
                        h = fences[int(ids[at])]
                        if h >= 0 and after[at] < len(own):
                            s[after[at]] -= FENCE_BONUS
                            s[after[at], h] += FENCE_BONUS
                scores.append(s)
                sizes.append(weight[kept])
            paths = best_paths(scores)
            rows: tuple[list, list, list, list] = ([], [], [], [])  # document, segment, lines, evidence
            for d, (s, size, path) in enumerate(zip(scores, sizes, paths)):
                if not len(s):
                    continue
                found = segments(path, size)
                if len(found) <= 1:  # one language, or only scraps: the whole text is one piece
                    found = [(0, len(path))]
                for n, (x, y) in enumerate(found):
                    rows[0].append(d)
                    rows[1].append(n)
                    rows[2].append(int(size[x:y].sum()))
                    # a segment is judged by the lines that its own language won, quotes inside it aside
                    own = s[x:y] if len(found) == 1 else s[x:y][path[x:y] == path[x]]
                    rows[3].append(own.sum(0, dtype=np.float64))
            taken = b.column(0).take(pa.array(rows[0], pa.int64()))
            vectors = np.stack(rows[3]).ravel() if rows[3] else np.zeros(0)
            ll = pa.ListArray.from_arrays(pa.array(np.arange(len(rows[0]) + 1, dtype=np.int32) * k), pa.array(vectors, pa.float64()))
            yield pa.RecordBatch.from_arrays([taken, pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), ll], names=[key, "segment", "n_lines", "ll"])

    return run


def suffix_of(path: Column) -> Column:
    """The part after the last dot of a path's last name, lower case; '' without one."""
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([^./\\\\\s]+)$", 1))


def declared_language(label: Column, names: dict[str, str]) -> Column:
    """The code that a label names, by code, name or alias in any case and with blanks around it; null where it names none."""
    table = F.create_map(*[x for k, v in sorted(names.items()) for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, F.lower(F.regexp_replace(label, r"^\s+|\s+$", "")))


def label_names(codes: list[tuple[str, str, list[str]]]) -> dict[str, str]:
    """Every known form of a language's name, lower case, to its code."""
    out: dict[str, str] = {}
    for code, name, aliases in codes:
        for x in (code, name, *(aliases or [])):
            if x:
                out.setdefault(x.strip().lower(), code)
    return out


def fit_model(samples: DataFrame, codes: DataFrame, docs: DataFrame | None = None, text: str = "text", label: str = "lang", path: str = "path", key: str = "doc_id") -> LineModel:
    """The line model from bounded labelled texts and the language vocabulary.

    Labelled texts are ``samples`` and, with ``docs``, at most MAX_AGREED documents of which the label and something else agree: the usual
    label of their file suffix or, for suffixes that hold several languages, the model fitted on the samples. Of these, only the lines
    that lie in their label's own segments are used in the last fit, so embedded languages teach nothing wrong.
    """
    rows = codes.select("code", "name", "aliases").limit(MAX_LANGS + 1).collect()
    if len(rows) > MAX_LANGS:
        raise ValueError("too many languages")
    names = label_names([(r["code"], r["name"], r["aliases"]) for r in rows])
    langs = sorted(r["code"] for r in rows)
    bounded = _hash_sample(samples.select("lang", "text", F.xxhash64("text").alias("h")), MAX_SAMPLES, F.length("text") <= MAX_TRAINING_CHARS)
    labelled = [(r["lang"], r["text"]) for r in bounded]
    model = LineModel.fit(labelled, langs, names)
    if docs is None:
        return model
    told = docs.select(F.xxhash64(F.col(key)).alias("h"), declared_language(F.col(label), names).alias("lang"), suffix_of(F.col(path)).alias("suffix"), F.col(text).alias("text"))
    taken = _hash_sample(told.where(F.col("lang").isNotNull()), MAX_AGREED, F.length("text") <= MAX_TRAINING_CHARS)
    by_suffix: dict[str, Counter[str]] = {}
    for r in taken:
        by_suffix.setdefault(r["suffix"], Counter())[r["lang"]] += 1
    usual = {x: c.most_common(1)[0][0] for x, c in by_suffix.items() if x and c.most_common(1)[0][1] * 2 > sum(c.values())}
    scored = _score_texts([r["text"] for r in taken], model)
    agreed = [
        (r["lang"], r["text"])
        for r, s in zip(taken, scored)
        if len(s) and (usual[r["suffix"]] == r["lang"] if r["suffix"] in usual else langs[int(s.sum(0).argmax())] == r["lang"])
    ]
    training = _Training(labelled + agreed, langs, names)
    own = len(training.docs) - len(agreed)
    keep = None
    for _ in range(2):
        held = training.scores(training.fit(keep))
        for x, c in zip(held, training.label):
            x[:, c] += LABEL_HOLD
        keep = [np.ones(len(d), bool) if i < own else p == c for i, (d, p, c) in enumerate(zip(training.docs, best_paths(held), training.label))]
    return training.fit(keep)


def _hash_sample(df: DataFrame, most: int, able: Column) -> list:
    """About ``most`` rows at most, those of the smallest hash ``h`` that are ``able``: a count over all rows, which reads no text, sets the threshold, so only rows below it are read whole."""
    n = df.count()
    if n > most:
        df = df.where(F.col("h") < int(-(2**63) + 2**64 * (most / n)))
    return sorted(df.where(able).collect(), key=lambda r: r["h"])[:most]


def _lines(text: str) -> list[str]:
    return [x for x in text.lstrip("\ufeff").splitlines() if x and not x.isspace() and not _FENCE.match(x)]


def _score_texts(texts: list[str], model: LineModel) -> list[np.ndarray]:
    numbered = _Numbered()
    ids = [[numbered[x] for x in _lines(t)] for t in texts]
    table = line_scores(list(numbered), model, _Index(model.vocab))
    return [table[np.array(i, np.int64)] for i in ids]


def identify(docs: DataFrame, model: LineModel, key: str, text: str, label: str, path: str, host: str, group: str, strength: float = 4.0) -> DataFrame:
    """A language with a confidence for each segment of each document.

    Lines are scored by the line model in batches, the likeliest path of languages cuts a document into segments, and each segment's text
    likelihood is fused with what is known beside the text: P(label | language), P(suffix | language) and the language shares of the
    document's host, smoothed towards those of its group and these towards the whole (``strength`` pseudo-documents). These tables are
    counted over all documents by grouped aggregation of the text-only decisions, so no document's evidence is gathered in one place.

    Result: key, segment (0, 1, ..), n_lines, lang, confidence, declared (the language the label names, or null). Cases: null,
    empty and blank texts give no rows; a null label, path, host or group is a value of its own; repeated rows come out as often; other
    columns are never looked at. Whole texts are read, whatever their length.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    langs = F.array(*[F.lit(c) for c in model.langs])
    k = len(model.langs)
    key_type = docs.schema[key].dataType.simpleString()
    about = docs.select(
        F.col(key), F.col(text), declared_language(F.col(label), model.names).alias("declared"), suffix_of(F.col(path)).alias("suffix"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("grp")
    )
    # facts beside the text travel through Python packed into the key column, so nothing has to be joined back
    packed = about.select(F.struct(key, "declared", "suffix", "host", "grp").alias("k"), F.col(text))
    pieces = packed.mapInArrow(_segment_batches(shared, "k"), f"k struct<`{key}`:{key_type},declared:string,suffix:string,host:string,grp:string>, segment int, n_lines int, ll array<double>")
    segs = cut_lineage(pieces.select(F.col("k").getField(key).alias(key), "k.declared", "k.suffix", "k.host", "k.grp", "segment", "n_lines", "ll"))
    first = F.element_at(langs, F.array_position("ll", F.array_max("ll")).cast("int"))
    decided = segs.select("declared", "suffix", "host", "grp", first.alias("lang"))

    def table(by: str, alias: str) -> DataFrame:
        return decided.groupBy(F.col(by).alias(f"__{by}")).agg(F.array(*[F.count_if(F.col("lang") == c).cast("double") for c in model.langs]).alias(alias))

    whole = decided.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # at most MAX_LANGS rows
    n_all = {r["lang"]: r["n"] for r in whole}
    total = sum(n_all.values())
    share = F.array(*[F.lit((n_all.get(c, 0) + 1.0) / (total + k)) for c in model.langs])
    per_lang = F.array(*[F.lit(float(n_all.get(c, 0))) for c in model.langs])
    joined = segs
    for by in ("host", "grp", "suffix", "declared"):
        t = settled(table(by, f"{by}_n"))  # beyond the bound an ordinary side, whose hot keys adaptive execution splits
        joined = joined.join(t, joined[by].eqNullSafe(F.col(f"__{by}")), "left").drop(f"__{by}")
    summed = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    joined = joined.withColumns({"host_t": summed("host_n"), "grp_t": summed("grp_n")})

    def fused(i: Column) -> Column:
        at = i + 1
        of_group = (F.element_at("grp_n", at) + strength * F.element_at(share, at)) / (F.col("grp_t") + strength)
        of_host = (F.element_at("host_n", at) + strength * of_group) / (F.col("host_t") + strength)
        suffix = (F.element_at("suffix_n", at) + 1) / (F.element_at(per_lang, at) + 50)
        stated = (F.element_at("declared_n", at) + 1) / (F.element_at(per_lang, at) + k)
        return F.element_at("ll", at) + F.ln(of_host * suffix * stated)

    posterior = joined.withColumn("post", F.transform("ll", lambda x, i: fused(i))).withColumn("top", F.array_max("post"))
    sure = 1 / F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    out = posterior.select(key, "segment", "n_lines", F.element_at(langs, F.array_position("post", F.col("top")).cast("int")).alias("lang"), sure.alias("confidence"), "declared")
    return out


def document_languages(segments_: DataFrame, key: str) -> DataFrame:
    """One row for each language of a document: key, lang, n_lines, confidence (of its surest segment), n_langs, declared."""
    by = segments_.groupBy(key, "lang").agg(F.sum("n_lines").alias("n_lines"), F.max("confidence").alias("confidence"), F.max("declared").alias("declared"))
    return by.withColumn("n_langs", F.count(F.lit(1)).over(Window.partitionBy(key)))  # at most MAX_LANGS rows a document
