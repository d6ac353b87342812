"""Search and recommendation: weighted fields, conjunctive terms with a fuzzy second tier, instant search, related items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import catalog_form, greek_to_latin, latin_letters, match_strength, osa_distance, search_form
from millrace.operators.rank import first_per_key

#: What a word counts in each field, and how headings of archives begin.
FIELD_WEIGHTS = {"owner": 120.0, "title": 95.0, "taxonomy": 90.0, "description": 8.0}
ARCHIVE = r"(?iu)^(archives|αρχεία)\s*[-–|:]"


def weighted_search(df: DataFrame, query: str, fields: dict[str, float], least: float = 240, boosts: list[tuple[Column, float]] | None = None, boost_first: bool = False) -> DataFrame:
    """Rows with ``score``: the best of strength times weight over the fields, in either script, from ``least`` on.

    Boosts are added to what is relevant by itself; with boost_first they count towards relevance.
    """
    plain, latin = search_form(F.lit(query)), greek_to_latin(F.lit(query))
    once = lambda rows, **made: rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))  # noqa: E731  a filter on what is made doesn't make it again
    rows = once(df, **{f"_form{k}": search_form(F.coalesce(F.col(c), F.lit(""))) for k, c in enumerate(fields)})
    strengths = []
    for k, w in enumerate(fields.values()):
        form = F.col(f"_form{k}")
        other = F.rlike(form, F.lit("[α-ω]")) | (plain != latin)  # else the same again in Latin letters
        strengths += [match_strength(form, plain) * w, F.when(other, match_strength(latin_letters(form), latin) * w)]
    extra = reduce(lambda a, b: a + b, [F.when(c, b).otherwise(0.0) for c, b in boosts or []], F.lit(0.0))
    scored = once(rows, _raw=F.greatest(*strengths)).drop(*[f"_form{k}" for k in range(len(fields))])
    tested = F.col("_raw") + extra if boost_first else F.col("_raw")
    return scored.filter(tested >= least).withColumn("score", F.floor(F.col("_raw") + extra + 0.5)).drop("_raw")


def suggestions(df: DataFrame, query: str, fields: dict[str, float], label: str, id_col: str, boosts: list[tuple[Column, float]] | None = None, k: int = 7) -> DataFrame:
    """The k best rows while one types, by weighted_search() with boosts counted before the threshold; nothing below two characters."""
    asked = query.strip()
    found = weighted_search(df, asked, fields, boosts=boosts, boost_first=True)
    return (found if len(asked) >= 2 else found.limit(0)).orderBy(F.desc("score"), label, id_col).limit(k)


def _terms(query: str) -> list[str]:
    """The distinct words of a query in catalogue form; none of a query that is too long or has too many."""
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", query) if not unicodedata.combining(c)).lower().replace("ς", "σ")
    words = "".join(c if c.isalnum() else " " for c in plain).split()
    terms = list(dict.fromkeys(words))
    return terms if len(" ".join(words)) <= 160 and len(terms) <= 12 else []


def _without_blanks(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def conjunctive_search(df: DataFrame, query: str, owner: str, title: str, taxonomy: list[str], description: str, id_col: str) -> DataFrame:
    """Rows that match every term, with score and ``approximate``: exact matches, or (if there are none) near ones as well.

    A term scores by its best field: owner 120, title 95, taxonomy 90, description 8; by prefix 0.6 of that from
    three letters on; near (four letters or more, one edit off, from eight letters two) 0.35 of that, never in the
    description. A row whose owner is the query, blanks aside, needn't match the terms and gains 1000; one whose
    title is it gains 400; headings of archives lose 50, unless the owner is the query.
    """
    terms = _terms(query)
    if not terms:
        return df.limit(0).withColumn("score", F.lit(0.0)).withColumn("approximate", F.lit(False))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    weights = FIELD_WEIGHTS
    sources = {"owner": text(owner), "title": text(title), "taxonomy": F.concat_ws(" ", *[text(c) for c in taxonomy]), "description": text(description)}
    forms = {c: catalog_form(x) for c, x in sources.items()}
    split = F.struct(*[F.filter(F.split(f, " "), lambda w: w != "").alias(c) for c, f in forms.items()]).alias("_words")
    whole = catalog_form(F.lit(query))
    is_owner = _without_blanks(forms["owner"]) == _without_blanks(whole)
    archive = ~is_owner & F.rlike(text(owner), F.lit(ARCHIVE))
    extra = F.when(is_owner, 1000.0).otherwise(0.0) + F.when(forms["title"] == whole, 400.0).otherwise(0.0) - F.when(archive, 50.0).otherwise(0.0)
    rows = df.select("*", split, is_owner.alias("_is_owner"), extra.alias("_extra"))

    def plain(term: str) -> Column:
        def field(c: str, w: float) -> Column:
            words = F.col("_words")[c]
            best = F.when(F.array_contains(words, term), w)
            if len(term) >= 3:
                best = best.when(F.exists(words, lambda x: F.startswith(x, F.lit(term))), w * 0.6)
            return best.otherwise(0.0)

        return F.greatest(*[field(c, w) for c, w in weights.items()])

    def ranked(found: DataFrame, scores: list[Column], approximate: bool) -> DataFrame:
        every = reduce(lambda a, b: a & b, [x > 0 for x in scores]) | F.col("_is_owner")
        total = reduce(lambda a, b: a + b, scores) + F.col("_extra")
        return found.filter(every).select(*[F.col(f"`{c}`") for c in df.columns], total.alias("score"), F.lit(approximate).alias("approximate"))

    exact = ranked(rows, [plain(t) for t in terms], False)
    # the near tier: distances are worked out once per distinct word of the catalogue that can be near
    fields = [c for c in weights if c != "description"]
    weighed = lambda c: F.transform(F.col("_words")[c], lambda w: F.struct(w.alias("word"), F.lit(weights[c]).alias("weight")))
    listed = F.concat(*[weighed(c) for c in fields])
    words = rows.select(F.col(id_col).alias("_id"), F.inline(listed)).filter(F.length("word") >= 4)
    asked = df.sparkSession.createDataFrame([(k, t, 2 if len(t) >= 8 else 1) for k, t in enumerate(terms) if len(t) >= 4], "_term int, _text string, _limit int")
    can = F.levenshtein("word", "_text") <= 2 * F.col("_limit")  # a swap is one edit, or two without swaps
    near = words.select("word").distinct().join(F.broadcast(asked), can).withColumn("_d", osa_distance(F.col("word"), F.col("_text"))).filter("_d <= _limit")
    best = words.join(near.select("word", "_term"), "word").groupBy("_id").agg(*[F.max(F.when(F.col("_term") == k, F.col("weight") * 0.35)).alias(f"_near{k}") for k in range(len(terms))])
    close = rows.join(best, F.col(id_col) == F.col("_id"), "left")
    close = ranked(close, [F.greatest(plain(t), F.coalesce(f"_near{k}", F.lit(0.0))) for k, t in enumerate(terms)], True)
    none_exact = exact.agg(F.count("*").alias("_found")).filter("_found = 0").select(F.lit(1).alias("_only"))
    return exact.unionByName(close.join(F.broadcast(none_exact)).drop("_only"))


def instant_scores(title: str, owner: str, context: str, asked: list[Column]) -> tuple[Column, Column, Column, Column]:
    """Of a row and a query (in its forms): points for matches, points for near words, whether the title or the owner
    begins with the query's first letter, and how long the query is."""
    size = F.length(asked[0])

    def plain(column: str, base: int, q: Column) -> Column:
        text = search_form(F.coalesce(F.col(column), F.lit("")))
        inside = F.exists(F.split(text, " "), lambda w: F.startswith(w, q))
        return F.when((q == "") | (text == ""), 0).when(text == q, base + 420).when(F.startswith(text, q), base + 330).when(inside, base + 250).when(F.contains(text, q), base + 170).otherwise(0)

    def near(column: str, base: int, q: Column) -> Column:
        own, theirs = (F.filter(F.split(t, " "), lambda w: F.length(w) >= 3) for t in (search_form(F.coalesce(F.col(column), F.lit(""))), q))

        def points(a: Column, b: Column) -> Column:
            d = F.levenshtein(a, b)
            allowed = F.when(F.greatest(F.length(a), F.length(b)) >= 8, 2).otherwise(1)
            return F.when((F.abs(F.length(a) - F.length(b)) <= 2) & (d <= allowed), base + 110 - 45 * d + F.least(F.length(a), F.length(b))).otherwise(0)

        best = F.array_max(F.flatten(F.transform(theirs, lambda a: F.transform(own, lambda b: points(a, b)))))
        return F.when(F.length(q) >= 3, F.coalesce(best, F.lit(0))).otherwise(0)

    greatest = lambda xs: F.greatest(*xs) if len(xs) > 1 else xs[0]
    exact = greatest([plain(c, b, q) for q in asked for c, b in ((title, 1650), (owner, 1580))] + [F.when(size > 1, plain(context, 760, q)).otherwise(0) for q in asked])
    fuzzy = greatest([near(c, b, q) for q in asked for c, b in ((title, 1180), (owner, 1120))])
    begins = reduce(lambda a, b: a | b, [F.substring(search_form(F.coalesce(F.col(c), F.lit(""))), 1, 1) == F.substring(q, 1, 1) for c in (title, owner) for q in asked])
    return exact, fuzzy, begins, size


def instant_search(
    df: DataFrame,
    query: str,
    title: str,
    owner: str,
    context: str,
    id_col: str,
    limit: int = 8,
    forms: list[str] | None = None,
    bonuses: list[tuple[Column, float]] | None = None,
) -> DataFrame:
    """The best rows as one types, with their score.

    Titles 1650, owners 1580, context 760, and 420 if exact, 330 for a prefix, 250 for a word's, 170 inside. From
    three characters on, while fewer than ``limit`` rows match so, rows whose title or owner begins with the query's
    letter may be near: 1180 and 1120, and 110 less 45 for each edit, plus the shorter word's letters; words of three
    letters or more, one edit apart, from eight letters two. forms: other ways to write the query (synonyms), of
    which the best counts; bonuses are added to any score.
    """
    asked = [search_form(F.lit(query.strip())), greek_to_latin(F.lit(query.strip())), *[search_form(F.lit(f)) for f in forms or ()]]
    exact, fuzzy, begins, size = instant_scores(title, owner, context, asked)
    more = reduce(lambda a, b: a + b, [F.when(c, b).otherwise(0.0) for c, b in bonuses or []], F.lit(0.0))
    scored = df.select("*", exact.alias("_exact"), more.alias("_more"))
    found = scored.filter("_exact > 0").withColumn("score", F.col("_exact") + F.col("_more"))
    full = found.limit(limit).agg(F.count("*").alias("_n"), F.max(size).alias("_size")).filter(F.col("_n") < limit).select(F.lit(1).alias("_only"))
    close = scored.filter((F.col("_exact") == 0) & (size >= 3) & begins).withColumn("_near", fuzzy).filter("_near > 0")
    close = close.join(F.broadcast(full)).withColumn("score", F.col("_near") + F.col("_more")).drop("_only", "_near")
    return found.unionByName(close).drop("_exact", "_more").orderBy(F.desc("score"), owner, title, id_col).limit(limit)


def related(df: DataFrame, current: dict, links: dict[str, tuple[DataFrame, float]], id_col: str, owner: str, same_owner: float, k: int) -> DataFrame:
    """The k best other rows: points for the same owner and for each shared key of the link frames (id_col, key), one row per owner."""
    mine = F.lit(current[id_col])
    points = [df.filter((F.col(owner) == F.lit(current[owner])) & (F.col(id_col) != mine)).select(id_col, F.lit(float(same_owner)).alias("points"))]
    for frame, weight in links.values():
        keys = frame.filter(F.col(id_col) == mine).select("key").distinct()
        shared = frame.filter(F.col(id_col) != mine).join(keys, "key", "left_semi").select(id_col, "key").distinct()
        points.append(shared.select(id_col, F.lit(float(weight)).alias("points")))
    total = reduce(DataFrame.unionByName, points).groupBy(id_col).agg(F.sum("points").alias("score")).filter("score > 0")
    once = first_per_key(df.join(total, id_col), [owner], [F.desc("score"), F.col(id_col)])
    return once.orderBy(F.desc("score"), id_col).limit(k)
