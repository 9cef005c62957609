"""Personal data in texts, and terms that give it away, by DataFrame functions alone.

Base kinds are found by pattern: e-mail, IP, card and phone. Their values are the protected entities. Over the whole
corpus, the pointwise mutual information of entity and term,

    PMI(e; t) = log2(N c(e, t) / (n(e) n(t))),

says how much of the entity's information content IC(e) = log2(N / n(e)) the term discloses: n counts documents,
c(e, t) the documents that hold both. A term with PMI >= REMOVE * IC is removed, from GENERALISE * IC on it is
generalised to its shape, wherever it stands in the documents that hold the entity. Only terms seen with the entity in
at least SUPPORT texts of their own, or beside it in as many contexts, are judged; for an entity in two texts both are
enough. Near copies are one text: texts count by the least distinct value among BANDS of minima over their terms.

An entity in fewer than SUPPORT texts, as most are, says little alone. Those of one kind are also pooled as one entity,
whose documents with a term are those where the term stands near a member; the term needs SUPPORT contexts and members.
Whole documents would bring chance words here. A rare word beside one address, or beside its copies, has no evidence
and stays.

A word run together with a base span is part of it and no term. Positions and marked texts are made in blocks of
matches and of BLOCK code points, so that a long text full of matches costs its length and not the square of it.

Defined results: null and empty texts have no spans; long texts are read whole; repeated rows get the same spans;
spans count code points, ends are exclusive; other columns are kept by ``sanitise`` and never read, except that
names beginning with ``_pii_`` are reserved; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare

#: Code points beside an entity that are its context, and the shortest term.
CONTEXT = 60
TERM = r"\p{L}[\p{L}\p{Nd}_]{3,}"
SUPPORT = 3
#: Texts count as near copies where one of so many groups of so many minima agrees.
BANDS, MINIMA = 12, 3
REMOVE, GENERALISE = 0.9, 0.75
#: Matches whose positions are counted together, and code points of a block of text.
MATCHES, BLOCK = 256, 4_096
#: A letter that stands for each code point of a base span where terms are sought.
FILLER = "\ua8f2"
#: Judged terms are broadcast up to so many and so many bytes.
FEW_TERMS, FEW_BYTES = 200_000, 8 << 20

KINDS = ("email", "ip", "card", "phone", "term")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

# Possessive loops and look-behind keep these linear and free of recursion; the matches are those of the plain
# patterns, as a later start in a run of the same characters can't succeed where its beginning fails.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){13,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"

_FOUND = "array<struct<start:int,end:int,match:string>>"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def located(text: Column, pattern: str) -> Column:
    """The pattern's matches with their code-point positions."""

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match")))).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))

    def positions(pairs: Column) -> Column:
        """Positions within parts of MATCHES, then shifted by the lengths of the parts before."""
        numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / MATCHES).cast("int"))
        parts = F.transform(numbers, lambda n: F.aggregate(F.slice(pairs, n * MATCHES + 1, MATCHES), begin, step))
        moved = lambda part, by: F.transform(part["out"], lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["match"].alias("match")))
        return _let(parts, lambda p: F.flatten(F.zip_with(p, _before(p, F.lit(0), lambda at, part: at + part["at"]), moved)))

    none = F.array().cast(_FOUND)
    gaps = lambda found: F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    pairs = lambda found: F.zip_with(gaps(found), found, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, _let(pairs(found), positions)).otherwise(none))


def _before(values: Column, first: Column, step) -> Column:
    """For each value what ``step`` makes of those before it, from ``first`` on."""
    begin = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, begin, lambda s, v: F.struct(step(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]


def _covered(spans: Column) -> Column:
    """For each span, by start, where those before it end, in parts of MATCHES; one more for the end of all."""
    furthest = lambda at, span: F.greatest(at, span["end"])
    numbers = F.sequence(F.lit(0), F.floor(F.size(spans) / MATCHES).cast("int"))
    parts = F.transform(numbers, lambda n: F.slice(spans, n * MATCHES + 1, MATCHES))
    within = lambda ps: F.transform(ps, lambda part: _before(part, F.lit(0), furthest))
    ends = lambda ps: _before(F.transform(ps, lambda part: F.struct(F.aggregate(part, F.lit(0), furthest).alias("end"))), F.lit(0), furthest)
    all_of = lambda ps: F.flatten(F.zip_with(within(ps), ends(ps), lambda own, low: F.transform(own, lambda x: F.greatest(x, low))))
    last = F.aggregate(spans, F.lit(0), furthest)
    return F.concat(_let(parts, all_of), F.array(last))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut_out(blocks: Column, begin: Column, end: Column) -> Column:
    """The text from ``begin`` up to ``end``."""
    first, last = F.floor(begin / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    part = lambda at, low, n: F.coalesce(F.substring(F.get(blocks, at), low + 1, n), F.lit(""))
    between = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    several = F.concat(part(first, begin - first * BLOCK, F.lit(BLOCK)), between, part(last, F.lit(0), end - last * BLOCK))
    return F.when(end <= begin, F.lit("")).when(first == last, part(first, begin - first * BLOCK, end - begin)).otherwise(several)


def _replaced(text: Column, spans: Column, mark) -> Column:
    """The text with ``mark(span, begin)`` in place of each span's part from ``begin`` on, where spans before it end."""

    def made(blocks: Column, spans: Column, before: Column) -> Column:
        # a span that begins inside one before it has no gap and, for most marks, nothing in its place
        parts = F.zip_with(spans, F.slice(before, F.lit(1), F.size(spans)), lambda s, low: F.concat(_cut_out(blocks, low, F.greatest(s["start"], low)), mark(s, low)))
        return F.concat(F.array_join(parts, ""), _cut_out(blocks, F.element_at(before, -1), F.lit(2**31 - 1 - BLOCK)))

    return _let(spans, lambda s: _let(_blocks(text), lambda b: _let(_covered(s), lambda before: made(b, s, before))))


def _kind(found: Column, kind: str, value, holds) -> Column:
    named = F.transform(
        F.filter(found, lambda m: holds(m["match"])),
        lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"), value(m["match"]).alias("value")),
    )
    return named


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end, value) by start and kind; ``kind`` is an index of KINDS."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    digit = text.rlike("[0-9]")
    card = lambda m: F.length(digits(m)).between(14, 19) & F.coalesce(F.call_function("luhn_check", digits(m)), F.lit(False))
    email = _kind(located(text, EMAIL), "email", F.lower, lambda m: F.lit(True))
    ip = _kind(located(text, IP), "ip", lambda m: m, lambda m: m.rlike(IP_PARTS))
    cards = _kind(located(text, CARD), "card", digits, card)
    phone = _kind(located(text, PHONE), "phone", digits, lambda m: F.length(digits(m)).between(10, 15))
    return F.array_sort(
        F.concat(
            F.when(text.contains("@"), email).otherwise(none),
            F.when(digit & text.contains("."), ip).otherwise(none),
            F.when(digit, cards).otherwise(none),
            F.when(digit & text.contains("+"), phone).otherwise(none),
        )
    )


def _masked(text: Column, spans: Column) -> Column:
    """The text with a letter that no term has in place of each code point of a base span."""
    return F.when(F.size(spans) > 0, _replaced(text, spans, lambda s, low: F.repeat(F.lit(FILLER), F.greatest(s["end"] - F.greatest(s["start"], low), F.lit(0))))).otherwise(text)


def _found_terms(masked: Column) -> Column:
    return F.filter(located(masked, TERM), lambda m: ~F.contains(m["match"], F.lit(FILLER)))


def _context(text: Column, masked: Column, spans: Column) -> Column:
    """Array of (entity, context, term): the terms beside each base span."""
    none = F.array().cast("array<struct<entity:bigint,context:bigint,term:string>>")

    def beside(blocks: Column, hidden: Column, n: Column, span: Column) -> Column:
        low, high = F.greatest(span["start"] - CONTEXT, F.lit(0)), F.least(span["end"] + CONTEXT, n)
        entity = F.xxhash64(span["kind"], span["value"])
        context = F.xxhash64(_cut_out(blocks, low, span["start"]), _cut_out(blocks, span["end"], high))
        # a term at the cut edge of the context may be part of a longer word
        part = F.concat(_cut_out(hidden, low, span["start"]), F.lit(" "), _cut_out(hidden, span["end"], high))
        whole = F.filter(_found_terms(part), lambda m: ((low == 0) | (m["start"] > 0)) & ((high == n) | (m["end"] < high - low - span["end"] + span["start"] + 1)))
        return F.transform(whole, lambda m: F.struct(entity.alias("entity"), context.alias("context"), F.lower(m["match"]).alias("term")))

    found = lambda b, h, n: F.flatten(F.transform(spans, lambda s: beside(b, h, n, s)))
    return F.when(F.size(spans) > 0, _let(F.length(text), lambda n: _let(_blocks(text), lambda b: _let(_blocks(masked), lambda h: found(b, h, n))))).otherwise(none)


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _row_key() -> Column:
    return F.xxhash64(_text())


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _entities(spans: Column) -> Column:
    """Array of (entity, pool): each base span's entity and its kind's pool."""
    return F.transform(spans, lambda s: F.struct(F.xxhash64(s["kind"], s["value"]).alias("entity"), F.xxhash64(F.lit("pool"), s["kind"]).alias("pool")))


def _bands(terms: Column) -> Column:
    """Hashes of groups of minima over a text's terms."""
    least = lambda seed: F.array_min(F.transform(terms, lambda t: F.xxhash64(t, F.lit(seed))))
    return F.array(*[F.xxhash64(*[F.coalesce(least(MINIMA * band + i), F.lit(0)) for i in range(MINIMA)]) for band in range(BANDS)])


def find(documents: DataFrame) -> DataFrame:
    """(doc_id, key, base, added) for each row: base spans and the terms to remove or generalise.

    ``key`` is a hash of the text, so that rows which share a doc_id keep their own spans.
    """
    prepare(documents.sparkSession)
    rows = documents.select("doc_id", _text().alias("text"))
    spotted = rows.select("doc_id", _row_key().alias("key"), "text", base_spans(F.col("text")).alias("base"))
    holds = F.size("base") > 0
    spotted = spotted.withColumn("masked", F.when(holds, _masked(F.col("text"), F.col("base"))))
    spotted = cut(
        spotted.select(
            "doc_id", "key", "base", "masked", _context(F.col("text"), F.col("masked"), F.col("base")).alias("context"),
            F.when(holds, _entities(F.col("base"))).alias("entities"),
            F.when(holds, F.filter(_terms(F.col("masked")), lambda t: ~F.contains(t, F.lit(FILLER)))).alias("terms"),
        )
    )
    members, disclosing = _disclosing(rows, spotted)

    told = members.join(disclosing, "entity").groupBy("doc_id", "key", "term").agg(F.max("removed").alias("removed"))
    told = told.groupBy("doc_id", "key").agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("told"))
    own = spotted.select("doc_id", "key", "base")
    texts = _joined(told, spotted.where(holds).select("doc_id", "key", "masked").dropDuplicates(["doc_id", "key"]))
    each = F.transform(_found_terms(F.col("masked")), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.try_element_at(F.col("told"), F.lower(m["match"])).alias("removed")))
    added = texts.select("doc_id", "key", F.filter(each, lambda m: m["removed"].isNotNull()).alias("added"))
    same = own["doc_id"].eqNullSafe(added["doc_id"]) & (own["key"] == added["key"])
    return own.join(added, same, "left").select(own["doc_id"], own["key"], "base", F.coalesce("added", F.array().cast("array<struct<start:int,end:int,removed:boolean>>")).alias("added"))


def _disclosing(rows: DataFrame, spotted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, entity) of the documents that hold an entity or a member of a pool, and (entity, term, removed) of
    the terms that disclose one beyond the thresholds."""
    holding = spotted.where("entities is not null")
    held = holding.select("doc_id", "key", F.inline("entities")).distinct()
    bands = cut(holding.select("doc_id", "key", "terms", _bands(F.col("terms")).alias("bands")).dropDuplicates(["doc_id", "key"]))
    by_document = cut(held.join(_texts(_joined(held, bands), ["entity"]), "entity"))
    rare = F.col("texts") < SUPPORT
    members = by_document.select("doc_id", "key", "entity").unionByName(by_document.where(rare).select("doc_id", "key", F.col("pool").alias("entity")).distinct())

    # of an entity: anywhere in its texts, or in the contexts that the term stands in
    known = by_document.where("texts >= 2").select("doc_id", "key", "entity", F.least("texts", F.lit(SUPPORT)).alias("wanted"))
    beside = spotted.where(F.size("context") > 0).select("doc_id", "key", F.inline("context")).groupBy("doc_id", "key", "entity", "term", "context").agg(F.lit(1).alias("one"))
    near = beside.groupBy("entity", "term", "context").agg(F.lit(1).alias("one")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("near")).where(F.col("near") >= SUPPORT)
    whole = _joined(known, bands).select("doc_id", "key", "entity", "wanted", "bands", F.explode("terms").alias("term"))
    whole = _texts(whole, ["entity", "term", "wanted"]).where("texts >= wanted").select("entity", "term")
    either = whole.unionByName(near.select("entity", "term")).distinct()
    sought = _joined(by_document.join(either.select("entity").distinct(), "entity", "left_semi").select("doc_id", "key", "entity"), bands)
    own = sought.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both")).join(either, ["entity", "term"])

    # of a pool: beside its members
    pooled = beside.join(by_document.where(rare).select("entity", "pool").distinct(), "entity")
    counted = [pooled.groupBy("pool", "term", *c).agg(F.lit(1).alias("one")).groupBy("pool", "term").agg(F.count(F.lit(1)).alias(n)) for c, n in ((["context"], "contexts"), (["entity"], "members"), (["doc_id", "key"], "n_both"))]
    pool = counted[0].where(F.col("contexts") >= SUPPORT).join(counted[1].where(F.col("members") >= SUPPORT), ["pool", "term"]).join(counted[2], ["pool", "term"])
    judged = cut(own.select("entity", "term", "n_both").unionByName(pool.select(F.col("pool").alias("entity"), "term", "n_both")))

    with_entity = members.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    total = spotted.count()
    sought = judged.select("term").distinct()
    size = sought.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    terms = rows.select(F.explode(_terms(F.col("text"))).alias("term"))
    count = F.count(F.lit(1)).alias("n_term")
    if size["n"] <= FEW_TERMS and size["bytes"] <= FEW_BYTES:
        with_term = terms.join(F.broadcast(sought), "term", "left_semi").groupBy("term").agg(count)
    else:
        with_term = terms.groupBy("term").agg(count).join(sought, "term", "left_semi")
    information = F.log2(F.lit(float(max(total, 1))) / F.col("n_entity"))
    mutual = F.log2(F.lit(float(max(total, 1))) * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    found = judged.join(with_entity, "entity").join(with_term, "term").select("entity", "term", mutual.alias("pmi"), information.alias("ic"))
    found = found.where((F.col("ic") > 0) & (F.col("pmi") >= GENERALISE * F.col("ic"))).select("entity", "term", (F.col("pmi") >= REMOVE * F.col("ic")).alias("removed"))
    return members, found


def _texts(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and the number of texts that are no near copies: distinct values of the band that has the fewest."""
    each = rows.select(*by, F.posexplode("bands").alias("band", "value")).groupBy(*by, "band", "value").agg(F.lit(1).alias("one"))
    return each.groupBy(*by, "band").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.min("n").alias("texts"))


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """An inner join by document, for a null id too."""
    right = right.withColumnsRenamed({"doc_id": "right_id", "key": "right_key"})
    return left.join(right, left["doc_id"].eqNullSafe(right["right_id"]) & (left["key"] == right["right_key"])).drop("right_id", "right_key")


def sanitise(documents: DataFrame) -> DataFrame:
    """``documents``, all rows and columns, with marks in place of base spans and disclosing terms."""
    prepare(documents.sparkSession)
    columns = documents.columns
    rows = documents.withColumn("_pii_base", base_spans(_text()))
    plain = rows.where(F.size("_pii_base") == 0).select(*columns)
    found = find(documents).where(F.size("base") > 0).select(F.col("doc_id").alias("_pii_id"), F.col("key").alias("_pii_key"), F.col("added").alias("_pii_added")).distinct()
    touched = rows.where(F.size("_pii_base") > 0).withColumn("_pii_hash", _row_key())
    touched = touched.join(found, touched["doc_id"].eqNullSafe(found["_pii_id"]) & (touched["_pii_hash"] == found["_pii_key"]), "left")
    marks = F.array(*[F.lit(MARKS[k]) for k in KINDS[:4]])
    base = F.transform("_pii_base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(marks, s["kind"] + 1).alias("mark")))
    text = F.col("text")
    shape = lambda s: F.when(s["removed"], F.lit("")).when(
        F.substring(text, s["start"] + 1, F.lit(1)).rlike(r"\p{Lu}"), F.lit("[NAME]")
    ).otherwise(F.lit("[TERM]"))
    added = F.transform(
        F.coalesce("_pii_added", F.array().cast("array<struct<start:int,end:int,removed:boolean>>")),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), shape(s).alias("mark")),
    )

    clean = _replaced(text, F.array_sort(F.concat(base, added)), lambda s, low: F.when(s["start"] >= low, s["mark"]).otherwise(F.lit("")))
    return plain.unionByName(touched.withColumn("text", clean).select(*columns))


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row."""
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda at: F.size(F.filter("base", lambda s: s["kind"] == at)).cast("long").alias(f"n_{KINDS[at]}")
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    added = F.transform("added", lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index("term")).alias("kind"), s["end"].alias("end")))
    return find(documents).select(
        "doc_id",
        *[count(at) for at in range(4)],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat(plain, added))).alias("spans"),
    )
