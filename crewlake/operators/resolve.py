"""Names in free text to known entities, and what to say when nothing matches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewlake.functions.ordered import latest, neighbour
from crewlake.functions.phrases import relative_range
from crewlake.functions.scalars import AsOf, full_name, has_text, norm_name
from crewlake.operators.patterns import find_patterns
from crewlake.session import kept, new_folder

# --- fixed values ---------------------------------------------------------------------------
AUTO, CANDIDATE, SUGGEST = 90.0, 70.0, 55.0
RUNNERS = 3
TYPE_PRIORITY = ["site", "client", "supplier", "project", "company", "person"]
LOOKUP_ORDER = ["site", "project", "client", "supplier", "company", "person"]
MIN_NAME, MIN_PHRASE = 3, 4
STOP_WORDS = ["the", "and", "for", "what", "who", "show", "timesheet", "roster", "site", "week", "last", "this", "next",
              "month", "all", "about", "hours", "project", "client", "list", "give", "how", "many", "worker", "workers",
              "automation", "github"]
WORD = r"([A-Za-z][A-Za-z0-9&.-]{2,})"
ABBREVIATION = r"(?<![A-Za-z0-9])([A-Z][A-Z&]{1,3})(?![A-Za-z0-9])"
EXPLICIT = r"(?i)(site|project|client|supplier|company)\s*[=:：]\s*([A-Za-z0-9 _.&-]+)"
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
SORT_CODES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghij"
STAGES = (90.0, 70.0, 55.0)
#: Letters of a text that fit one number, with a bit to spare for the carry.
WORD_BITS = 62

CHITCHAT = r"(?iU)^(hi|hello|hey|thanks?|thank you|ok|okay|cool|great|good|nice|bye|你好|谢谢|好的|嗯|哈喽)\W*$"
QUESTION = (r"(?i)[?？]|^(who|what|which|how|when|where|is |are |do |does |can |show|list|give|"
            r"谁|什么|哪|多少|怎么|是否|有没有)")
SITE_RULE = r"(?iU)([A-Za-z][A-Za-z0-9 \-_]{1,24}?)\s*(?:要求|的要求是|requires?|needs?)\s*[:：]?\s*(.+)"
SUPPLIER_FLAG = (r"(?iU)([A-Za-z一-鿿][\w\- ]{1,30}?)\s*(?:经常出问题|老出问题|有问题|不靠谱|风险很高|"
                 r"is (?:a )?(?:problem|risky|high[- ]risk)|keeps? (?:causing|having) (?:issues|problems))")
DEFINITION = r"(?iU)([A-Za-z一-鿿][\w ]{1,30}?)\s*(?:的定义是|的意思是|意思是|means|is defined as)\s+(.{3,200})"
PREFERENCE = r"(?i)(?:我喜欢|我希望|每周给我|每天给我|I (?:like|prefer|want)|remind me|给我.*报告)"
FACT = r"(?i)要求|规则|必须|记住|policy|rule|remember|always|never"
TICKET_SPLIT = r"[,，、+\n]| and "

PERSON_STOP = ["What", "About", "And", "The", "How", "Who", "Show", "Same", "Last", "This", "Next", "Week", "Month",
               "Today", "Tomorrow"]
PERSON = r"(?<![A-Za-z0-9])([A-Z][A-Za-z]{2,})(?![A-Za-z0-9])"
DATE_ARGS = ["date_from", "date_to", "month", "period", "year"]
PERSON_ARGS = ["worker_id", "worker_name", "name"]
PERSON_ARG = {"search_employee": "name", "get_employee_profile": "name"}
NO_PERSON_ARG = ["get_worker_licences"]
FOLLOWUP = (r"(?i)那|呢|换成|改成|那么|还有|这个|那个|他|她|这周|上周|下周|这个月|上个月"
            r"|what about|how about|and (for|in|at)\b|same (for|but)|instead")
FOLLOWUP_CHARS = 12
ENTITY_ARGS = ["site", "project", "client"]
# ----------------------------------------------------------------------------------------------


# --- vocabulary ---------------------------------------------------------------------------------------

def vocabulary(names: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """(type, norm, value) dictionary; of several spellings with one comparison form the first wins.

    ``names`` is (type, value, source_rank); people enter under full name and under surname.
    """
    rows = names.select("type", F.trim("value").alias("value"), "source_rank").filter("value IS NOT NULL")
    if people is not None:
        known = people.filter("first_name IS NOT NULL AND last_name IS NOT NULL").select(
            full_name().alias("full"), "last_name").distinct()
        person = known.select(F.lit("person").alias("type"), F.trim("full").alias("value"), F.explode(
            F.array(F.struct(F.col("full").alias("k"), F.lit(0).alias("source_rank")),
                    F.struct(F.col("last_name").alias("k"), F.lit(1).alias("source_rank")))).alias("x")).select(
            "type", "value", norm_name("x.k").alias("norm"), "x.source_rank")
        rows = rows.withColumn("norm", norm_name("value")).unionByName(person)
    else:
        rows = rows.withColumn("norm", norm_name("value"))
    rows = rows.filter(F.length("norm") >= MIN_NAME)
    return latest(rows, ["type", "norm"], ["source_rank", "value"], first=True).drop("source_rank")


# --- exact indel similarity ---------------------------------------------------------------------------------

def letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two character arrays."""
    n = F.size(b)

    def step(row: Column, ch: Column) -> Column:
        def cell(new: Column, j: Column) -> Column:
            same = F.get(b, j - 1) == ch
            best = F.when(same, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.get(new, j - 1)))
            return F.array_append(new, best)
        return F.aggregate(F.sequence(F.lit(1), n), F.array(F.lit(0)), cell)

    return F.get(F.aggregate(a, F.array_repeat(F.lit(0), n + 1), step), n)


def similarity(a: Column, b: Column) -> Column:
    """Share of characters kept when one text is turned into the other by inserting and deleting, 0..100."""
    total = F.length(a) + F.length(b)
    return F.when(total > 0, 200.0 * lcs_length(letters(a), letters(b)) / total).otherwise(0.0)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _masks(a: Column) -> Column:
    """For each letter of an array of letters a number with one bit per place where the letter stands."""
    places = F.sequence(F.lit(0), F.size(a) - 1)
    kinds = F.array_distinct(a)
    bits = F.transform(kinds, lambda c: F.aggregate(
        F.filter(places, lambda i: F.get(a, i) == c), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(_bit(i))))
    return F.map_from_arrays(kinds, bits)


def _common(masks: Column, la: Column, b: Column) -> Column:
    """:func:`lcs_length` of a text of at most ``WORD_BITS`` letters, given by its masks, and letters ``b``: a row of the table is one number."""
    full = _bit(la) - 1

    def step(open_places: Column, ch: Column) -> Column:
        met = open_places.bitwiseAND(F.coalesce(F.try_element_at(masks, ch), F.lit(0).cast("long")))
        return (open_places + met).bitwiseOR(open_places - met).bitwiseAND(full)

    return la - F.bit_count(F.aggregate(b, full, step))


# --- the name index ------------------------------------------------------------------------------------------

def _tokens(c: Column, order: str) -> Column:
    """Each character with its running number in the text, so equal texts share all tokens; rare letters first."""
    def token(i: Column) -> Column:
        ch, head = F.substring(c, i, F.lit(1)), F.substring(c, F.lit(1), i)
        nth = F.length(head) - F.length(F.replace(head, ch, F.lit("")))
        return F.concat(F.translate(ch, order, SORT_CODES), nth.cast("string"))
    return F.array_sort(F.transform(F.sequence(F.lit(1), F.length(c)), token))


def _need(la: Column, lb: Column, threshold: float) -> Column:
    """Characters two texts of these lengths must share to reach the threshold."""
    return F.ceil((la + lb) * threshold / 200.0 - 1e-9).cast("int")


def _shortest(length: Column, threshold: float) -> Column:
    """Length of the shortest text that can reach the threshold with a text of this length."""
    return F.greatest(F.ceil(length * (threshold / (200.0 - threshold)) - 1e-9).cast("int"), F.lit(1))


def _pairs(tokens: Column, length: Column, threshold: float) -> Column:
    """Pairs (sig, at) of the rarest tokens, ``at`` being the place of the less rare one; as many as any other text may ask for."""
    longest = F.greatest(length - _need(length, _shortest(length, threshold), threshold) + 2, F.lit(0))
    prefix = F.slice(tokens, F.lit(1), F.least(longest, length))

    def with_rest(x: Column, i: Column) -> Column:
        rest = F.sequence(i + 2, F.size(prefix))
        return F.when(i + 2 <= F.size(prefix), F.transform(rest, lambda k: F.struct(F.concat(x, F.lit("~"), F.get(prefix, k - 1)).alias("sig"), k.alias("at")))).otherwise(
            F.array().cast("array<struct<sig:string,at:int>>"))
    return F.flatten(F.transform(prefix, with_rest))


class NameIndex:
    """A stored index of names for similarity search: built once, grown by merging, looked up by equi-joins.

    Two texts that are similar enough share at least ``t`` numbered characters.  Sorted from rare to common, their first
    ``len - t + 2`` ones must then have two in common.  The index holds the pairs of rare characters of every name with the
    place that the pair needs; a look-up joins on the pair and compares places and lengths, so one index serves every
    threshold from ``floor`` on, and no name is missed.  The letters' order is fixed when the index is built: rare letters
    of later names only cost time.

    Folders under ``root``: ``order`` (one row), ``pairs`` (sig, at, v_norm, lv), ``entries`` (type, norm, value).  Pairs are
    written first; a lost merge leaves pairs of names that no entry names, which a rerun adds once more without effect.
    """

    def __init__(self, spark: SparkSession, root: str, order: str | None = None, floor: float | None = None):
        self.spark, self.root, self.order, self.floor = spark, root, order, floor
        if order is None:
            self.order, self.floor = spark.read.parquet(f"{root}/order").first()
        self.entries = spark.read.schema("type string, norm string, value string").parquet(f"{root}/entries")
        self.pairs = spark.read.schema("sig string, at int, v_norm string, lv int").parquet(f"{root}/pairs")

    @classmethod
    def build(cls, vocab: DataFrame, root: str | None = None, floor: float = SUGGEST) -> NameIndex:
        """Index a dictionary (type, norm, value) under ``root``, by default a new folder in the shared one."""
        spark = vocab.sparkSession
        root = root or new_folder(spark, "names")
        entries = kept(vocab.select("type", "norm", "value"), f"{root}/entries")
        order = letter_order(entries)
        spark.createDataFrame([(order, float(floor))], "letters string, floor double").coalesce(1).write.parquet(f"{root}/order")
        cls._pairs_of(entries.select("norm").distinct(), order, floor).write.parquet(f"{root}/pairs")
        return cls(spark, root, order, floor)

    @staticmethod
    def _pairs_of(norms: DataFrame, order: str, floor: float) -> DataFrame:
        rows = norms.select(F.col("norm").alias("v_norm"), F.length("norm").alias("lv"), _tokens(F.col("norm"), order).alias("tok"))
        return rows.select("v_norm", "lv", F.inline(_pairs(F.col("tok"), F.col("lv"), floor))).select("sig", "at", "v_norm", "lv")

    def merge(self, vocab: DataFrame) -> NameIndex:
        """The index with the entries of ``vocab`` that it lacks; of a known type and form the stored value stays."""
        new = kept(vocab.select("type", "norm", "value").join(self.entries.select("type", "norm"), ["type", "norm"], "left_anti"))
        norms = new.select("norm").distinct().join(self.entries.select("norm"), "norm", "left_anti")
        self._pairs_of(norms, self.order, self.floor).write.mode("append").parquet(f"{self.root}/pairs")
        new.write.mode("append").parquet(f"{self.root}/entries")
        return NameIndex(self.spark, self.root)

    def near(self, terms: DataFrame, threshold: float, best: int | None = None, form: Column | None = None,
             types: Sequence[str] | None = None) -> DataFrame:
        """(norm, type, value, raw_score, score) of all names of ``types`` that reach ``threshold``, at least the floor.

        With ``best`` a term is looked up in stages, from very similar to the threshold, and leaves as soon as a stage has
        found that many different names, told apart by ``form`` (the value): all names above the stage's bound are known
        then, so its best ``best`` are exact, and the many weaker pairs of names that differ in a digit or two are never made.
        What is left after a stage is stored, so no stage runs twice.
        """
        if threshold < self.floor - 1e-9:
            raise ValueError(f"this index holds no names below {self.floor}")
        form = F.col("value") if form is None else form
        entries = self.entries if types is None else self.entries.filter(F.col("type").isin(list(types)))
        text = letters(F.col("norm"))
        left = kept(terms.select("norm").distinct().filter("norm <> ''").select(
            "norm", F.length("norm").alias("lt"), _tokens(F.col("norm"), self.order).alias("tok"), F.when(F.length("norm") <= WORD_BITS, _masks(text)).alias("masks")))
        parts = []
        for stage in [*[s for s in STAGES if best is not None and s > threshold + 1e-9], threshold]:
            found = self._stage(left, stage).join(entries.withColumnRenamed("norm", "v_norm"), "v_norm").select(
                "norm", "type", "value", "raw_score", F.round("raw_score", 1).alias("score"))
            if stage == threshold:
                parts.append(found)
                break
            found = kept(found)
            done = found.groupBy("norm").agg(F.count_distinct(form).alias("_names")).filter(F.col("_names") >= int(best)).select("norm")
            parts.append(found.join(done, "norm", "left_semi"))
            left = kept(left.join(done, "norm", "left_anti"))
        return reduce(DataFrame.unionByName, parts)

    def _stage(self, terms: DataFrame, threshold: float) -> DataFrame:
        """(norm, v_norm, raw_score) of all pairs of at least ``threshold``."""
        asked = terms.select("norm", "lt", F.inline(_pairs(F.col("tok"), F.col("lt"), threshold))).withColumnRenamed("at", "t_at")
        met = asked.join(self.pairs, "sig")
        need = _need(F.col("lt"), F.col("lv"), threshold)
        fits = (F.least("lt", "lv") >= need) & (F.col("t_at") <= F.col("lt") - need + 2) & (F.col("at") <= F.col("lv") - need + 2)
        pairs = met.filter(fits).select("norm", "v_norm").distinct().join(terms.select("norm", "lt", "masks"), "norm")
        other = letters(F.col("v_norm"))
        common = F.when(F.col("masks").isNotNull(), _common(F.col("masks"), F.col("lt"), other)).otherwise(lcs_length(letters(F.col("norm")), other))
        return pairs.withColumn("raw_score", 200.0 * common / (F.col("lt") + F.length("v_norm"))).filter(
            F.col("raw_score") >= threshold - 1e-9).select("norm", "v_norm", "raw_score")


def letter_order(vocab: DataFrame) -> str:
    """The letters of comparison forms from rare to common, as counted in the dictionary (36 numbers, one scan)."""
    seen = vocab.agg(*[F.count_if(F.col("norm").contains(ch)).alias(f"n_{ch}") for ch in ALPHABET]).first()
    return "".join(sorted(ALPHABET, key=lambda ch: (seen[f"n_{ch}"] or 0, ch)))


def _indexed(vocab: DataFrame | NameIndex, floor: float) -> NameIndex:
    return vocab if isinstance(vocab, NameIndex) else NameIndex.build(vocab, floor=floor)


def near_names(terms: DataFrame, vocab: DataFrame | NameIndex, threshold: float, best: int | None = None,
               types: Sequence[str] | None = None) -> DataFrame:
    """(norm, vocabulary entry) pairs with similarity of at least ``threshold``; see :meth:`NameIndex.near`."""
    return _indexed(vocab, threshold).near(terms, threshold, best, types=types)


def _rank(order: Sequence[str], c: str = "type") -> Column:
    pos = F.array_position(F.array(*map(F.lit, order)), F.col(c))
    return F.when(pos > 0, pos).otherwise(len(order) + 1)


def collapse(found: DataFrame) -> DataFrame:
    """One candidate per term and comparison form: best score, then the more important type."""
    keyed = found.withColumn("v_key", norm_name("value"))
    return latest(keyed.withColumn("_p", -_rank(TYPE_PRIORITY)), ["norm", "v_key"], ["score", "_p", "value"]).drop("v_key", "_p")


# --- T1 ---------------------------------------------------------------------------------------------------------

def resolve_mentions(mentions: DataFrame, vocab: DataFrame | NameIndex, aliases: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Mention -> status, matched entity and up to four candidates, of ``types`` only if given.

    Exact comparison form first, then alias, then similarity.  A single candidate of 90 or more is a match and the next best
    ones from 70 on are offered beside it; several of 90 or more are ambiguous; 70 to 90 are only offered.  An alias stands
    for whatever its target resolves to, by similarity too; one whose target has no match is passed over.
    """
    index = _indexed(vocab, CANDIDATE)
    entries = index.entries if types is None else index.entries.filter(F.col("type").isin(list(types)))
    goals = resolve_aliases(aliases, index, types)
    m = mentions.select("mention").distinct().withColumn("norm", norm_name("mention"))
    known = kept(direct(m, entries, goals))

    # only what is still open enters the similarity join
    lists = _offers(known.filter("_value IS NULL AND length(norm) >= 2"), index, types)
    rows = known.join(lists, "norm", "left")
    found = F.col("_value").isNotNull()
    first = F.get("c", F.lit(0))
    runners = F.size(F.filter(F.col("c"), lambda x: (x["n"] > 1) & (x["score"] >= AUTO)))
    hit = F.coalesce((first["score"] >= AUTO) & (runners == 0), F.lit(False))
    status = (F.when(found, F.col("_how")).when(F.col("c").isNull(), "none").when(hit, "fuzzy")
              .when(first["score"] >= AUTO, "ambiguous").when(F.size("c") > 1, "ambiguous").otherwise("none"))
    offered = F.array_join(F.transform(F.filter("c", lambda x: ~hit | (x["n"] > 1)),
                                       lambda x: F.concat(x["value"], F.lit(" ("), x["type"], F.lit(")"))), " / ")
    return rows.select(
        "mention", "norm", status.alias("status"),
        F.when(found, F.col("_type")).when(hit, first["type"]).alias("type"),
        F.when(found, F.col("_value")).when(hit, first["value"]).alias("value"),
        F.when(found, F.lit(100.0)).when(hit, first["score"]).alias("score"), offered.alias("candidates"))


def _offers(terms: DataFrame, index: NameIndex, types: Sequence[str] | None) -> DataFrame:
    """(norm, c): the best four candidates of each term, one per comparison form of the name."""
    best = Window.partitionBy("norm").orderBy(F.desc("score"), _rank(TYPE_PRIORITY), "value")
    near = index.near(terms, CANDIDATE, RUNNERS + 1, norm_name("value"), types)
    top = collapse(near).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= RUNNERS + 1)
    # at most four candidates per term reach this aggregation
    return top.groupBy("norm").agg(F.sort_array(F.collect_list(F.struct("n", "type", "value", "score"))).alias("c"))


def resolve_aliases(aliases: DataFrame, index: NameIndex, types: Sequence[str] | None = None) -> DataFrame:
    """(norm, type, value) of every alias whose target resolves: exactly, by another alias (up to three in a row), or as the
    single name of 90 or more."""
    entries = index.entries if types is None else index.entries.filter(F.col("type").isin(list(types)))
    steps = kept(aliases.select(norm_name("alias").alias("norm"), norm_name("value").alias("_to")).dropDuplicates(["norm"]))
    meant = entries.join(steps.select(F.col("_to").alias("norm")), "norm", "left_semi").withColumn("_p", _rank(LOOKUP_ORDER))
    exact = kept(latest(meant, ["norm"], ["_p"], first=True).select(F.col("norm").alias("_to"), "type", "value"))
    goal = steps
    for _ in range(3):  # a target that is no name may be an alias itself
        onward = steps.select(F.col("norm").alias("_to"), F.col("_to").alias("_next"))
        goal = goal.join(exact.select("_to", F.lit(True).alias("_known")), "_to", "left").join(onward, "_to", "left").select(
            "norm", F.when(F.col("_known").isNull(), F.coalesce("_next", "_to")).otherwise(F.col("_to")).alias("_to"))
    goal = kept(goal.join(exact, "_to", "left"))
    unknown = goal.filter("type IS NULL").select(F.col("_to").alias("norm"))
    if unknown.isEmpty():
        return goal.select("norm", "type", "value")
    # only a single name of AUTO or more counts, so one stage tells
    near = collapse(index.near(unknown, AUTO, form=norm_name("value"), types=types)).filter(F.col("score") >= AUTO)
    close = near.groupBy("norm").agg(F.count("*").alias("_n"), F.first(F.struct("type", "value")).alias("_c")).filter("_n = 1").select(
        F.col("norm").alias("_to"), "_c")
    return kept(goal.join(close, "_to", "left").select(
        "norm", F.coalesce("type", "_c.type").alias("type"), F.coalesce("value", "_c.value").alias("value")).filter("value IS NOT NULL"))


def direct(m: DataFrame, vocab: DataFrame, goals: DataFrame, typed: bool = False) -> DataFrame:
    """Rows with ``norm`` (and ``type`` when ``typed``) plus _type, _value, _how of an exact or alias hit.

    ``goals`` is what :func:`resolve_aliases` gives.  Left joins keep every row, so the input is read once and nothing is
    subtracted again.
    """
    on = ["type", "norm"] if typed else ["norm"]
    one = (vocab.select("type", "norm", "value") if typed else
           latest(vocab.withColumn("_p", _rank(LOOKUP_ORDER)), ["norm"], ["_p"], first=True).select("norm", "type", "value"))
    long_enough = F.length("norm") >= 2
    hit = one.select(*([F.col("type")] if typed else []), "norm", F.col("type").alias("_t1"), F.col("value").alias("_v1"))
    goal = goals.select(*([F.col("type")] if typed else []), "norm", F.col("type").alias("_t2"), F.col("value").alias("_v2"))
    rows = m.join(hit, on, "left").join(goal, on, "left")
    exact, alias = F.col("_v1").isNotNull() & long_enough, F.col("_v2").isNotNull() & long_enough
    return rows.select(
        *m.columns, F.when(exact, F.col("_t1")).when(alias, F.col("_t2")).alias("_type"),
        F.when(exact, F.col("_v1")).when(alias, F.col("_v2")).alias("_value"),
        F.when(exact, "exact").when(alias, "alias").alias("_how"))


def suggest(terms: DataFrame, vocab: DataFrame | NameIndex, limit: int = 5, types: Sequence[str] | None = None) -> DataFrame:
    """T4: the ``limit`` closest entities per term from 55 on, one per name, of ``types`` only if given."""
    t = kept(terms.select("mention").distinct().withColumn("norm", norm_name("mention")).filter("norm <> ''"))
    near = _indexed(vocab, SUGGEST).near(t, SUGGEST, limit, types=types)
    one = latest(near.withColumn("_p", -_rank(LOOKUP_ORDER)), ["norm", "value"], ["score", "_p"]).drop("_p")
    w = Window.partitionBy("norm").orderBy(F.desc("score"), _rank(LOOKUP_ORDER), "value")
    top = one.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= int(limit))
    return t.join(top, "norm").select("mention", "n", "type", "value", "score")


# --- T5 ---------------------------------------------------------------------------------------------------------

def phrases(c: Column | str) -> Column:
    """One- to three-word phrases that do not start with a stop word."""
    words = F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(WORD), 1)

    def at(w: Column, i: Column) -> Column:
        most = F.when(F.lower(w).isin(STOP_WORDS), 0).otherwise(F.least(F.size(words) - i, F.lit(3)))
        sizes = F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), most)
        return F.transform(sizes, lambda n: F.array_join(F.slice(words, i + 1, n), " "))
    return F.array_distinct(F.flatten(F.transform(words, at)))


def detect_mentions(questions: DataFrame, vocab: DataFrame | NameIndex, aliases: DataFrame) -> DataFrame:
    """T5: the one entity each question is about: (question_id, type, value, score, raw).

    An explicit ``site=x`` wins and is kept even when unknown; otherwise the longest phrase
    that resolves; otherwise a capital abbreviation known as an alias.  Different phrases are resolved once, however many
    questions say them.
    """
    index = _indexed(vocab, CANDIDATE)
    entries, goals = index.entries, resolve_aliases(aliases, index)
    q = questions.select("question_id", "text")
    cols = ["question_id", "type", "value", "score", "raw"]

    stated = q.select("question_id", F.lower(F.regexp_extract("text", EXPLICIT, 1)).alias("type"),
                      F.trim(F.regexp_extract("text", EXPLICIT, 2)).alias("raw")).filter("type <> ''")
    # a stated kind is kept, so an alias stands for the entity of that kind which it names
    typed_goals = aliases.select(norm_name("alias").alias("norm"), norm_name("value").alias("_to")).dropDuplicates(["norm"]).join(
        entries.withColumnRenamed("norm", "_to"), "_to").select("norm", "type", "value")
    asked = kept(direct(stated.select("type", "raw", norm_name("raw").alias("norm")).distinct(), entries, typed_goals, typed=True))
    near = index.near(asked.filter("_value IS NULL"), AUTO)
    close = latest(near.select("norm", "type", "value", "score"), ["norm", "type"], ["score", "value"])
    known = asked.join(close, ["norm", "type"], "left").select(
        "raw", "type", F.coalesce("_value", "value").alias("_best"),
        F.when(F.col("_value").isNotNull(), 100.0).otherwise(F.col("score")).alias("_score"))
    explicit = stated.join(known, ["raw", "type"], "left").select(
        "question_id", "type", F.coalesce("_best", "raw").alias("value"), F.coalesce("_score", F.lit(0.0)).alias("score"), "raw",
        F.lit(3).alias("_kind"), F.lit(0).alias("_len"))

    # the phrases are read twice, so they are stored; questions are dealt out first, whatever files they come in
    said = kept(q.repartition("question_id", "text").select("question_id", F.explode(phrases("text")).alias("mention")).filter(
        F.length(norm_name("mention")) >= MIN_PHRASE))
    hits = kept(resolve_mentions(said.select("mention"), index, aliases).filter(F.col("score") >= AUTO))
    spoken = said.join(hits, "mention").select(
        "question_id", "type", "value", "score", F.col("mention").alias("raw"), F.lit(2).alias("_kind"), F.length("norm").alias("_len"))

    short = q.select("question_id", F.posexplode(F.regexp_extract_all("text", F.lit(ABBREVIATION), 1)).alias("p", "raw"))
    abbr = short.withColumn("norm", norm_name("raw")).filter("length(norm) >= 2").join(goals, "norm").join(
        entries.select("norm"), "norm", "left_anti").select(
        "question_id", "type", "value", F.lit(100.0).alias("score"), "raw", F.lit(1).alias("_kind"), (-F.col("p")).alias("_len"))
    every = explicit.unionByName(spoken).unionByName(abbr)
    return latest(every, ["question_id"], ["_kind", "_len", "score", "raw"]).select(*cols)


# --- T9 ---------------------------------------------------------------------------------------------------------

def coverage_note(table: DataFrame, column: str, date_from: str | None, date_to: str | None) -> DataFrame:
    """First and last day of a table and whether a requested range lies outside."""
    span = table.agg(F.min(column).alias("first_day"), F.max(column).alias("last_day"))
    before = F.lit(date_to) < F.col("first_day")
    after = F.lit(date_from) > F.col("last_day")
    return span.withColumn("note", F.when(before, "range is BEFORE coverage").when(after, "range is AFTER coverage")
                           .otherwise("range overlaps coverage"))


def related_probes(probes: Sequence[tuple[str, DataFrame, Column | str, str]], term: str) -> DataFrame:
    """Where else a term occurs: (table, proves, rows) for probes that hit."""
    parts = [df.agg(F.count_if(has_text(c, term)).alias("rows")).select(
        F.lit(table).alias("table"), F.lit(proves).alias("proves"), "rows") for table, df, c, proves in probes]
    return reduce(DataFrame.unionByName, parts).filter("rows > 0")


def zero_row_diagnosis(table: DataFrame, column: str, date_from: str, date_to: str, probes, term: str,
                       terms: DataFrame, vocab: DataFrame | NameIndex) -> DataFrame:
    """Everything worth saying about an empty answer as (step, subject, detail) rows."""
    cover = coverage_note(table, column, date_from, date_to).select(
        F.lit("coverage").alias("step"), F.concat_ws("..", "first_day", "last_day").alias("subject"), F.col("note").alias("detail"))
    probe = related_probes(probes, term).select(F.lit("related").alias("step"), F.col("table").alias("subject"),
                                                F.concat("proves", F.lit(": "), F.col("rows").cast("string")).alias("detail"))
    near = suggest(terms, vocab, 3).select(F.lit("candidate").alias("step"), F.col("value").alias("subject"),
                                           F.format_string("%s %.1f", "type", "score").alias("detail"))
    return cover.unionByName(probe).unionByName(near)


# --- T10/T11 -----------------------------------------------------------------------------------------------------

def classify_utterance(c: Column | str) -> dict[str, Column]:
    """Kind of an utterance and, for rules, its site and required tickets."""
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    tickets = F.transform(F.split(F.regexp_extract(t, SITE_RULE, 2), TICKET_SPLIT),
                          lambda x: F.lower(F.regexp_replace(F.regexp_replace(F.trim(x), r"^[.,;、]+|[.,;、]+$", ""), r"\s+", " ")))
    tickets = F.filter(tickets, lambda x: x != "")
    rule = t.rlike(SITE_RULE)
    kind = (F.when((t == "") | t.rlike(CHITCHAT), "chitchat").when(t.rlike(QUESTION) & ~rule, "question")
            .when(rule & (F.size(tickets) > 0), "site_rule").when(t.rlike(SUPPLIER_FLAG), "supplier_flag")
            .when(t.rlike(DEFINITION), "definition").when(t.rlike(PREFERENCE), "preference")
            .when(t.rlike(FACT), "fact").otherwise("none"))
    is_rule = kind == "site_rule"
    site = F.replace(F.lower(F.trim(F.regexp_extract(t, SITE_RULE, 1))), F.lit(" "), F.lit("_"))
    return {"kind": kind, "site": F.when(is_rule, site), "tickets": F.when(is_rule, tickets)}


def recall_rules(questions: DataFrame, sites: Sequence[str], definitions: Sequence[str] = (),
                 suppliers: Sequence[str] = ()) -> DataFrame:
    """Learned rules that a question touches, (question_id, kind, subject).

    A rule is touched where the question contains its subject, as it is or with spaces for underscores, in any case; flags of
    suppliers also where it is about suppliers or risk at all.  All subjects are searched for in one pass over the texts.
    """
    spark = questions.sparkSession
    rules = spark.createDataFrame([(k, n) for k, names in (("site_rule", sites), ("definition", definitions), ("supplier_flag", suppliers))
                                   for n in dict.fromkeys(names)], "kind string, subject string")
    forms = rules.withColumn("pattern", F.explode(F.array(F.lower("subject"), F.lower(F.replace(F.col("subject"), F.lit("_"), F.lit(" ")))))).distinct()
    asked = questions.select("question_id", F.lower("text").alias("text"))
    said = find_patterns(asked, forms).join(forms, "pattern").select("question_id", "kind", "subject").distinct()
    about_supply = F.col("text").rlike("supplier|供应商|risk|风险")
    flags = F.array(*[F.lit(n) for n in dict.fromkeys(suppliers)]) if suppliers else F.array().cast("array<string>")
    rest = asked.filter(about_supply).select("question_id", F.lit("supplier_flag").alias("kind"), F.explode(flags).alias("subject"))
    return said.unionByName(rest).distinct()


# --- T12 ---------------------------------------------------------------------------------------------------------

def reads_like_followup(c: Column | str) -> Column:
    """Whether a text names a difference to what was asked before: a phrase of that kind, or next to nothing at all."""
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    return t.rlike(FOLLOWUP) | (F.length(t) <= FOLLOWUP_CHARS)


def followups(turns: DataFrame, as_of: AsOf, bucket: Column | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Arguments of each turn after inheriting the last tool call before it.

    ``turns`` is (conversation_id, turn, text, tool, function, args map<string,string>).  Only a text that reads like a
    follow-up inherits.  A new time window, site, project, client or person in it replaces the inherited one; turns that
    change nothing or have nothing to inherit are left out.  ``entities`` is (conversation_id, turn, type, value), the
    entity that :func:`detect_mentions` finds in a turn.
    """
    usable = F.col("tool").isNotNull() & F.col("function").isNotNull() & ~F.col("tool").isin("memory", "meta")
    near = neighbour(turns, ["conversation_id"], ["turn"], F.floor(F.col("turn") / 256) if bucket is None else bucket,
                     ["tool", "function", "args"], only=usable)
    rows = near.filter(F.col("prev").isNotNull() & reads_like_followup("text"))
    if entities is None:
        rows = rows.withColumn("_slot", F.lit(None).cast("string")).withColumn("_entity", F.lit(None).cast("string"))
    else:
        named = entities.filter(F.col("type").isin(ENTITY_ARGS)).select("conversation_id", "turn", F.col("type").alias("_slot"), F.col("value").alias("_entity"))
        rows = rows.join(named, ["conversation_id", "turn"], "left")
    rows = rows.withColumn("_t", relative_range("text", as_of)).withColumn("_args", F.coalesce("prev.args", F.create_map().cast("map<string,string>")))
    ym = F.coalesce("_t.month", "_t.period")
    had_range = F.map_contains_key("_args", "date_from") | F.map_contains_key("_args", "date_to")
    as_range = had_range & ym.isNotNull()
    new_time = F.map_filter(F.create_map(
        F.lit("date_from"), F.when(as_range, F.concat(ym, F.lit("-01"))).otherwise(F.col("_t.date_from")),
        F.lit("date_to"), F.when(as_range, F.concat(ym, F.lit("-31"))).otherwise(F.col("_t.date_to")),
        F.lit("month"), F.when(~as_range, F.col("_t.month")), F.lit("period"), F.when(~as_range, F.col("_t.period")),
        F.lit("year"), F.col("_t.year")), lambda k, v: v.isNotNull())
    timed = F.col("_t.phrase").isNotNull()
    people = F.filter(F.regexp_extract_all("text", F.lit(PERSON), 1), lambda w: ~w.isin(PERSON_STOP))
    person = F.when(~F.col("prev.function").isin(NO_PERSON_ARG), F.get(people, F.lit(0)))
    key = F.when(F.col("prev.function").isin(list(PERSON_ARG)), "name").otherwise("worker_name")

    def without(m: Column, keys: Sequence[str], cond: Column) -> Column:
        return F.map_filter(m, lambda k, v: ~(cond & k.isin(list(keys))))

    swapped = F.coalesce(F.col("_slot").isNotNull() & ~F.try_element_at("_args", F.col("_slot")).eqNullSafe(F.col("_entity")), F.lit(False))
    base = without(without(F.col("_args"), DATE_ARGS, timed), PERSON_ARGS, person.isNotNull())
    base = F.map_filter(base, lambda k, v: ~(swapped & (k == F.col("_slot"))))
    none = F.create_map().cast("map<string,string>")
    extra = F.when(person.isNotNull(), F.create_map(key, person)).otherwise(none)
    entity = F.when(swapped, F.create_map(F.coalesce("_slot", F.lit("")), F.col("_entity"))).otherwise(none)
    merged = F.map_concat(base, F.when(timed, new_time).otherwise(none), extra, entity)
    return rows.filter(timed | person.isNotNull() | swapped).select(
        "conversation_id", "turn", F.col("prev.tool").alias("tool"), F.col("prev.function").alias("function"), merged.alias("args"),
        timed.alias("time_changed"), person.isNotNull().alias("person_changed"), swapped.alias("entity_changed"))


def alias_table(spark: SparkSession, aliases: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame(list(aliases.items()), "alias string, value string")
