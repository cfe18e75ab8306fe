"""Personal data: patterns, and terms that give protected values away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers, found by pattern and
checked (parts, Luhn, number of digits). Whatever they match is a protected entity.

Terms come from corpus statistics. A term is a word of letters anywhere in a document, outside its base
spans. With N documents, n(e) of them with the entity, n(t) with the term anywhere and n(e,t) with both,
a term's point-wise mutual information with the entity is log(n(e,t) N / (n(e) n(t))), and the entity's
information content is log(N / n(e)). Their ratio tells how much of the entity a reader learns from the
term; 1 means all. In documents that hold the entity, every occurrence of the term becomes a span: from
``generalise`` on it is replaced by a general word, from ``remove`` on it is taken out. Pairs seen in
fewer than ``support`` distinct texts say nothing and are left alone, as are texts without base spans.

As n(e,t) is n(e) at most, a term can reach the threshold g with an entity only if n(t) is at most
N (n(e) / N)^g. The count of documents with base spans and the term, which n(t) is at least, prunes terms
and pairs by that before the corpus is read for n(t).

Only DataFrame functions run here. Offsets are code points, ends exclusive. Null texts are empty, copies
of a text are no support for each other, and every input row gives one result row. Possessive
quantifiers and look-behinds keep the patterns linear on long runs and match the same spans; places
and pieces of a text with n matches take n log n steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from gridtide.functions.columns import field
from gridtide.llm.batches import let, pick
from gridtide.plans.work import written

KINDS = ("email", "ip", "card", "phone")
SUPPORT, GENERALISE, REMOVE = 3, 0.9, 1.0
# Terms up to this number (about 3 MB) are looked up by broadcast while the texts are read; for more of
# them the counts of all words are joined. Sanitised texts up to FEW_TEXTS get their terms by broadcast.
FEW_TERMS, FEW_TEXTS = 200_000, 10_000
# Code points of the parts that a text is cut into for taking pieces out of it.
CHUNK = 512
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
# Cheap tests that every text with a valid match passes.
_HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
_SPAN = "struct<start:int,kind:int,end:int,value:string>"
_WORD = r"\p{L}{3,}"
_NO_TERMS = "cast(array() as array<struct<start:int,end:int,value:string,removed:boolean>>)"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.coalesce(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).try_cast("int") <= 255, F.lit(False))
        return F.forall(F.split(value, "[.]"), part)
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Sums, or what ``both`` makes of two, of an array's values up to each place.

    Every pass adds what lies 1, 2, 4 ... places before, so n values take log n passes. A fold that
    appends to its result would copy it for every value.
    """

    def doubled(array: Column, number: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), number)
        return F.transform(array, lambda x, at: F.when(at < step, x).otherwise(both(x, F.get(array, at - step))))

    passes = F.sequence(F.lit(0), F.length(F.bin(F.size(values) - 1)) - 1)
    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(passes, values, doubled))


def _located(text: Column, pattern: str, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` over the values of a pattern's matches and the places where they end.

    The texts between the matches give the places.
    """

    def ends(gaps: Column, values: Column) -> Column:
        lengths = F.transform(values, lambda v, at: F.length(v) + F.length(F.get(gaps, at)))
        return let(lengths, lambda found: _running(found, lambda x, y: x + y))

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(values, lambda v: let(F.split(text, pattern, -1), lambda gaps: let(ends(gaps, v), lambda e: body(v, e))))


def _places(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the pattern's matches."""

    def listed(values: Column, ends: Column) -> Column:
        end = lambda at: F.get(ends, at)
        return F.transform(
            values, lambda v, at: F.struct((end(at) - F.length(v)).alias("start"), end(at).alias("end"), v.alias("value"))
        )

    return _located(text, pattern, listed)


def _pieces(text: Column, spans: Column, piece: Callable[[Callable, Column, Column], Column]) -> Column:
    """The text with a piece for each span, joined once: ``piece(part, done, span)``.

    ``done`` is the end of what earlier spans reach, and ``part(low, high)`` the text between two
    places. It is taken from chunks of the text, as the text itself would be counted through from its
    start for every span. Spans are sorted; after the last one the rest of the text follows.
    """

    def over(chunks: Column, found: Column, reach: Column) -> Column:
        def part(low: Column, high: Column) -> Column:
            first, last = F.floor(low / CHUNK).cast("int"), F.floor((high - 1) / CHUNK).cast("int")
            begin = low - first * CHUNK + 1
            within = F.substring(F.get(chunks, first), begin, high - low)
            middle = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            across = F.concat(F.substring(F.get(chunks, first), begin, F.lit(CHUNK)), middle, F.substring(F.get(chunks, last), F.lit(1), high - last * CHUNK))
            return F.when(high <= low, "").when(first == last, within).otherwise(across)

        done = lambda at: F.when(at == 0, 0).otherwise(F.get(reach, at - 1))
        made = F.transform(found, lambda span, at: let(done(at), lambda d: piece(part, d, span)))
        return F.concat(F.array_join(made, ""), part(done(F.size(found)), F.length(text)))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    reach = lambda found: let(F.transform(found, lambda s: s["end"]), lambda ends: _running(ends, F.greatest))
    return let(chunks, lambda c: let(spans, lambda found: let(reach(found), lambda r: over(c, found, r))))


def _kind_spans(text: Column, kind: str) -> Column:
    valid = F.filter(_places(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    number = F.lit(KINDS.index(kind)).alias("kind")
    return F.transform(
        valid, lambda s: F.struct(s["start"].alias("start"), number, s["end"].alias("end"), s["value"].alias("value"))
    )


def base_spans(text: Column) -> Column:
    """All valid base spans (start, kind, end, value), sorted by start, then kind as listed."""
    found = []
    for kind in KINDS:
        found.append(F.when(text.rlike(_HINTS[kind]), _kind_spans(text, kind)).otherwise(F.lit(None)))
    empty = F.expr(f"cast(array() as array<{_SPAN}>)")
    return F.array_sort(F.concat(*(F.coalesce(part.cast(f"array<{_SPAN}>"), empty) for part in found)))


def _content(text: Column) -> Column:
    """Identity of a text: two hashes and the length."""
    return F.concat_ws("-", F.hex(F.xxhash64(text)), F.hex(F.hash(text)), F.octet_length(text))


def detect(
    docs: DataFrame,
    support: int = SUPPORT,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, ``base`` spans (start, kind, end, value) and ``terms`` (start, end, value, removed)."""
    texts = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    base = written(_based(texts))
    words = _words_of_texts(base, texts, support, generalise, remove)
    spans = F.expr(f"transform(spans, s -> cast(struct(s.start, s.kind, s.end, s.value) as {_SPAN}))").alias("base")
    if words is None:
        return base.select("doc_id", spans, F.expr(_NO_TERMS).alias("terms"))
    return base.join(words, "content", "left").select("doc_id", spans, _occurrences(F.col("rest"), F.col("words")).alias("terms"))


def _based(texts: DataFrame) -> DataFrame:
    """Base spans and, where there are any, the text with blanks for them; other texts are left behind."""
    spans = texts.select("doc_id", "text", base_spans(F.col("text")).alias("spans"))
    return spans.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.when(F.size("spans") > 0, _content(F.col("text"))).alias("content"),
        "spans",
        F.when(F.size("spans") > 0, _blanked(F.col("text"), F.col("spans"))).alias("rest"),
    )


def _blanked(text: Column, spans: Column) -> Column:
    """The text with a blank for every character of these sorted spans."""

    def piece(part: Callable, done: Column, span: Column) -> Column:
        blanks = F.repeat(F.lit(" "), F.greatest(span["end"] - F.greatest(span["start"], done), F.lit(0)))
        return F.concat(part(done, span["start"]), blanks)

    return _pieces(text, spans, piece)


def _terms(text: Column) -> Column:
    """The distinct words in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda w: F.lower(w)))


def _occurrences(text: Column, words: Column) -> Column:
    """Spans of all occurrences in the text of the words of a map to ``removed``; empty for a null map."""

    def listed(values: Column, ends: Column) -> Column:
        def span(value: Column, at: Column) -> Column:
            end = F.get(ends, at)
            removed = F.try_element_at(words, F.lower(value))
            return F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"), removed.alias("removed"))

        return F.filter(F.transform(values, span), lambda s: s["removed"].isNotNull())

    return F.when(words.isNull() | text.isNull(), F.expr(_NO_TERMS)).otherwise(_located(text, _WORD, listed))


def _words_of_texts(base: DataFrame, texts: DataFrame, support: int, generalise: float, remove: float) -> DataFrame | None:
    """content and its disclosing words, a map to ``removed``; None where there are none."""
    total = base.count()
    some = base.filter("content IS NOT NULL")
    chosen = written(some.groupBy("content").agg(F.min("row").alias("row"), F.count("*").alias("copies")))
    single = some.join(chosen.select("row", "copies"), "row")
    names = F.array_distinct(F.transform("spans", lambda s: F.concat(s["kind"].cast("string"), F.lit(":"), F.lower(s["value"]))))
    entities = single.select("row", "copies", F.explode(names).alias("entity"))
    known = entities.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("n_texts"))
    most = F.lit(float(total)) * F.pow(F.col("n_entity") / F.lit(float(total)), F.lit(float(generalise))) * (1 + 1e-9)
    known = known.filter((F.col("n_texts") >= support) & (F.col("n_entity") < total))
    known = written(known.select("entity", "n_entity", most.alias("most")))
    bound = known.agg(F.max("most")).first()[0]
    if bound is None:
        return None
    held = entities.join(known, "entity").groupBy("row").agg(
        F.collect_list(F.struct("entity", "n_entity", "most")).alias("entities"), F.max("most").alias("most")
    )
    held = written(single.join(held, "row").select("row", "content", "copies", "entities", "most", _terms(F.col("rest")).alias("terms")))
    beside = held.select("copies", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("copies").alias("n_term"), F.count("*").alias("n_texts")
    )
    beside = written(beside.filter((F.col("n_texts") >= support) & (F.col("n_term") <= bound)).drop("n_texts"))
    pairs = _together(held, beside).groupBy("entity", "n_entity", "term", "n_term").agg(
        F.sum("copies").alias("n_both"), F.count("*").alias("n_texts")
    )
    likely = written(_disclosing(pairs.filter(F.col("n_texts") >= support), total, generalise).drop("information", "shared", "n_texts"))
    if likely.isEmpty():
        return None
    counts = _term_counts(texts, likely.select("term").distinct())
    scored = _disclosing(likely.drop("n_term").join(counts, "term"), total, generalise)
    scored = written(scored.select("entity", "term", "n_term", (F.col("shared") >= F.lit(remove) * F.col("information")).alias("removed")))
    words = _together(held, scored.select("term", "n_term").distinct()).join(scored.drop("n_term"), ["entity", "term"])
    words = words.groupBy("row", "term").agg(F.max("removed").alias("removed"))
    words = words.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("words"))
    words = written(words.join(held.select("row", "content"), "row").select("content", "words"))
    few = words.count() <= FEW_TEXTS and (words.agg(F.max(F.size("words"))).first()[0] or 0) <= 100
    return F.broadcast(words) if few else words


def _together(held: DataFrame, terms: DataFrame) -> DataFrame:
    """One row for each text, entity and term in it that the term's count lets reach the threshold."""
    words = held.select("row", "copies", "most", F.explode("terms").alias("term"))
    words = words.join(F.broadcast(terms) if terms.count() <= FEW_TERMS else terms, "term").filter("n_term <= most").drop("most")
    words = words.join(held.select("row", F.explode("entities").alias("e")), "row").filter("n_term <= e.most")
    return words.select("row", "copies", "term", "n_term", "e.entity", "e.n_entity")


def _disclosing(pairs: DataFrame, total: int, share: float) -> DataFrame:
    """Pairs whose mutual information is at least this share of the entity's information."""
    scored = pairs.withColumn("information", F.log(F.lit(total) / F.col("n_entity"))).withColumn(
        "shared", F.log(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    )
    return scored.filter((F.col("information") > 0) & (F.col("shared") >= F.lit(share) * F.col("information")))


def _term_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Number of documents that hold each of these terms; summed up before any shuffle."""
    words = texts.select(F.explode(_terms(F.col("text"))).alias("term"))
    terms = written(terms)
    few = terms.count() <= FEW_TERMS
    if few:
        words = words.join(F.broadcast(terms), "term")
    counts = words.groupBy("term").agg(F.count("*").alias("n_term"))
    return counts if few else counts.join(terms, "term")


def span_text(spans: Column, kind: Column | None = None) -> Column:
    """Spans as ``kind:start:end``, comma-joined in the given order."""
    names = F.array(*(F.lit(k) for k in (*KINDS, "term")))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """The documents with their text sanitised; all other columns and rows stay as they are.

    A base span becomes its kind in brackets, a generalised term ``[TERM]``, a removed term nothing.
    Overlapping spans are replaced together, by the first one's word. A null text stays null.
    """
    text = field(text_col)
    texts = docs.select(F.lit(None).cast("bigint").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    options = {"support": SUPPORT, "generalise": GENERALISE, "remove": REMOVE} | thresholds
    words = _words_of_texts(written(_based(texts)), texts, **options)
    own = "own_row_" + "_".join(docs.columns)
    row = docs.select(F.struct(*(field(c) for c in docs.columns)).alias(own), F.coalesce(text, F.lit("")).alias("body"))
    if words is None:
        row = row.withColumn("base", base_spans(F.col("body"))).withColumn("terms", F.expr(_NO_TERMS))
    else:
        row = row.withColumn("content", _content(F.col("body"))).join(words, "content", "left")
        row = row.withColumn("base", base_spans(F.col("body")))
        rest = F.when(F.col("words").isNotNull(), _blanked(F.col("body"), F.col("base")))
        row = row.withColumn("rest", rest).withColumn("terms", _occurrences(F.col("rest"), F.col("words")))
    row = row.withColumn("spans", _words_for(F.col("base"), F.col("terms")))
    row = row.withColumn("clean", _replaced(F.col("body"), F.col("spans")))
    old = F.col(own)
    return row.select(
        *(
            (F.when(old[c].isNull(), None).otherwise(F.col("clean")) if c == text_col else old[c]).alias(c)
            for c in docs.columns
        )
    )


def _words_for(base: Column, terms: Column) -> Column:
    """All spans with the words that stand in for them, sorted."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    first = F.transform(
        base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["kind"] + 1).alias("word"))
    )
    second = F.transform(
        terms,
        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["removed"], "").otherwise("[TERM]").alias("word")),
    )
    return F.array_sort(F.concat(first, second))


def _replaced(text: Column, spans: Column) -> Column:
    def piece(part: Callable, done: Column, span: Column) -> Column:
        return F.when(span["start"] >= done, F.concat(part(done, span["start"]), span["word"])).otherwise("")

    return F.when(F.size(spans) == 0, text).otherwise(_pieces(text, spans, piece))
