"""Figures that replies state, checked against the sources that were read in the same run, and facts that must agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import figures as X

#: What a stated cut-off is for, and what a source must then say.
MAJORS, MAJOR, FILED = ("专业线", "专业录取线", "专业录取最低分"), "专业录取", "投档"
SCIENCE, ARTS = ("物理", "理科"), ("历史", "文科")


def found_roles(fragment: Column, line: Column, header: Column) -> Column:
    """(value, role) of the numbers of a fragment of a line that have one: from a label just before it, the unit after it, or the heading of its column."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), "。+$", "")
    whole = header.isNotNull() & F.contains(fragment, F.lit("|")) & ((line == fragment) | (bare(line) == bare(fragment)))
    return F.concat(X.labelled(fragment), F.when(whole, X.celled(fragment, header)).otherwise(F.array().cast("array<struct<value:decimal(28,8),role:string>>")))


def roles_of_numbers(fragment: Column, line: Column, header: Column) -> Column:
    """(value, roles) of the numbers of a fragment of a line."""
    of_value = lambda found, v: F.sort_array(F.array_distinct(F.transform(F.filter(found, lambda x: x["value"] == v), lambda x: x["role"])))
    return X.named_once(found_roles(fragment, line, header), lambda found: F.transform(X.values(fragment), lambda v: F.struct(v.alias("value"), of_value(found, v).alias("roles"))))


def number_roles(texts: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """Per fragment of a text and number in it: by, at, place, fragment, value and roles. Null texts have none. What a line is told by those above it comes from one pass over the lines of its text."""
    lines = texts.select(*by, F.inline(X.lines_below(F.col(text))))
    parts = lines.select(*by, "at", "line", "header", F.posexplode(X.parts_of(F.col("line"))).alias("place", "fragment")).where(F.col("fragment").rlike(r"\d"))
    return parts.select(*by, "at", "place", "fragment", F.inline(roles_of_numbers(F.col("fragment"), F.col("line"), F.col("header"))))


def schools_named(excerpt: Column) -> Column:
    """The schools that a source names."""
    return F.when(~X.says(excerpt, "大学", "学院"), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(excerpt, F.lit(f"{X.BEFORE_SCHOOL}({X.SCHOOL_NAME})"), 1))


def bound_schools(text: Column, known: Column) -> Column:
    """(names, unbound) of the schools that a text mentions: of each mention the longest known name that it ends with; unbound if one looks like a name and is not known."""
    near = X.LONGEST_SCHOOL // 2  # a piece has two characters at least
    longest = lambda lead: F.array_max(F.transform(F.filter(known, lambda n: F.endswith(lead, n)), lambda n: F.struct(F.length(n).alias("size"), n.alias("name"))))["name"]
    looks = lambda lead: lead.rlike(f"{X.SCHOOL_NAME}$") & ~lead.rlike(X.POINTS_BACK)

    def mentions(pieces: Column) -> Column:
        lead = lambda k: F.right(F.array_join(F.slice(pieces, F.greatest(k - near, F.lit(1)), F.least(k, F.lit(near + 1))), ""), F.lit(X.LONGEST_SCHOOL))
        leads = F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lead))
        return F.transform(leads, lambda x: X.named_once(x, lambda x: F.struct(longest(x).alias("name"), x.alias("lead"))))

    none = F.array().cast("array<struct<name:string,lead:string>>")
    found = F.when(X.says(text, "大学", "学院"), X.named_once(F.split(text, "(?<=大学|学院)"), mentions))
    read = lambda m: F.struct(F.array_distinct(F.array_compact(F.transform(m, lambda x: x["name"]))).alias("names"), F.exists(m, lambda x: x["name"].isNull() & looks(x["lead"])).alias("unbound"))
    return X.named_once(F.coalesce(found, none), read)


def _branch(text: Column) -> Column:
    """What a text says of the two branches: whether anything, of arts alone, of science alone."""
    arts, science = X.says(text, "历史类", "文科") & ~X.says(text, "物理", "理科"), X.says(text, "物理类", "理科") & ~X.says(text, "历史", "文科")
    return F.struct(X.says(text, "物理", "历史", "理科", "文科").alias("any"), arts.alias("arts"), science.alias("science"))


def stated_figures(claims: DataFrame) -> DataFrame:
    """The sentences of claims (text, supplied, known and whatever else) that state numbers which need a source: sentence, said, cutoff, sure and stated, the numbers.

    Numbers that the user supplied may be repeated, unless a sentence states them as a cut-off.
    """
    said = F.col("said")
    each = claims.select("*", F.posexplode(F.split("text", r"(?<=[。！？!?])|\n")).alias("sentence", "said")).where(X.checked(said)).drop("text").withColumn("cutoff", X.cut_off(said))
    each = each.withColumn("sure", F.col("cutoff") & ~X.unsure(said))
    numbers = F.when(F.col("sure"), X.values(said)).otherwise(F.array_except(X.values(said), X.values(F.coalesce("supplied", F.lit("")))))
    return each.withColumn("stated", F.filter(numbers, lambda v: (v >= 100) | said.rlike(r"\d\s*(?:分|%|％|万|千)"))).drop("supplied")


def read_figures(excerpt: Column, years: Column, known: Column) -> Column:
    """The fragments of a source that hold numbers: fragment, values and found (value, role), both as written, and what fragment or else excerpt says of place, branch and year.

    Rows of a table that hold nothing but plain cells are their own numbers; their roles are those of the heading.
    """
    none, pairs = F.array().cast("array<string>"), "array<struct<value:string,role:string>>"

    def placed(x: Column, plain: Column) -> Column:
        rid = lambda text: X.provinces(F.aggregate(bound_schools(text, known)["names"], text, lambda text, name: F.replace(text, name)))
        return F.when(~plain & x["fragment"].rlike(f"(?=[一-鿿])(?:{X.PROVINCES})"), rid(x["fragment"])).otherwise(none)

    def of_row(x: Column) -> Column:
        below = lambda cells: F.when(F.size(cells) == F.size(x["header"]), F.arrays_zip(cells.alias("value"), x["header"].alias("role")))
        return X.named_once(F.split(x["fragment"], r"\|"), lambda cells: F.struct(cells.alias("values"), F.coalesce(below(cells), F.array().cast(pairs)).alias("found")))

    def of_text(x: Column) -> Column:
        roles = found_roles(x["fragment"], x["line"], x["header"])
        return F.struct(F.transform(X.values(x["fragment"]), X.written).alias("values"), F.transform(roles, lambda y: F.struct(X.written(y["value"]).alias("value"), y["role"])).alias("found"))

    def numbers(x: Column) -> Column:
        row = x["plain"] & (x["fragment"] == x["line"]) & x["fragment"].rlike(X.ROW)
        return F.when(row, of_row(x)).when(x["fragment"].rlike(r"\d"), of_text(x))

    def told(x: Column, around: Column) -> Column:
        says = lambda branch, years: F.struct(
            x["fragment"], x["numbers"]["values"], x["numbers"]["found"], F.when(F.size(x["provinces"]) > 0, x["provinces"]).otherwise(around["provinces"]).alias("provinces"),
            F.when(branch["any"], branch).otherwise(around["branch"]).alias("branch"), F.when(F.size(years) > 0, years).otherwise(around["years"]).alias("years"),
        )
        return X.named_once(_branch(x["fragment"]), lambda branch: X.named_once(X.asserted_years(x["fragment"]), lambda years: says(branch, years)))

    def part(line: Column, fragment: Column) -> Column:
        return X.named_once(X.plain(fragment), lambda p: F.struct(line["line"], line["header"], fragment.alias("fragment"), p.alias("plain")))

    parts = F.flatten(F.transform(X.lines_below(excerpt), lambda l: F.transform(X.parts_of(l["line"]), lambda f: part(l, f))))  # noqa: E741
    counted = F.filter(F.transform(parts, lambda x: F.struct(x["fragment"], placed(x, x["plain"]).alias("provinces"), numbers(x).alias("numbers"))), lambda x: (F.size(x["provinces"]) > 0) | (F.size(x["numbers"]["values"]) > 0))
    all_years = F.array_union(X.asserted_years(excerpt), F.coalesce(years, none))
    around = lambda parts: F.struct(F.array_distinct(F.flatten(F.transform(parts, lambda x: x["provinces"]))).alias("provinces"), _branch(excerpt).alias("branch"), all_years.alias("years"))
    own = lambda parts, around: F.transform(F.filter(parts, lambda x: F.size(x["numbers"]["values"]) > 0), lambda x: told(x, around))
    return X.named_once(counted, lambda parts: X.named_once(around(parts), lambda a: own(parts, a)))


def read_by_run(evidence: DataFrame) -> DataFrame:
    """(run, known, read): the schools that a run's sources name, and the figures they state. A run reads a few excerpts, so both are short lists, and each excerpt is read once."""
    sources = evidence.where("excerpt is not null").groupBy("run").agg(F.collect_list(F.struct("excerpt", "years")).alias("sources"))
    known = F.array_distinct(F.flatten(F.transform("sources", lambda s: schools_named(s["excerpt"]))))
    read = F.flatten(F.transform("sources", lambda s: read_figures(s["excerpt"], s["years"], F.col("known"))))
    return sources.withColumn("known", known).select("run", "known", read.alias("read"))


def check_figures(claims: DataFrame, evidence: DataFrame, conditions: DataFrame) -> DataFrame:
    """claim_id, sentence, value and verdict of the figures that claims state: SUPPORTED, UNSUPPORTED, or SCHOOL where a sentence names one that no source does.

    conditions: run, province, subjects, year, any of them null; claims of runs without conditions are not checked. A figure is supported if a source of its run has
    the same value in a fragment that gives it every role the claim does, and whose place, branch, school, kind of cut-off and year
    agree. A run reads a few excerpts; their figures are one list that its claims are held to. Claims meet their conditions and that list by run, before they are cut into
    sentences; from there on no row is dealt or sorted again.
    """
    asked = claims.select("run", "claim_id", "text", "supplied").join(conditions.select("run", "province", "subjects", "year"), "run").join(read_by_run(evidence), "run", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    c, said = F.col, F.col("said")
    any_stated = lambda value: F.when(F.size("stated") > 0, value)
    whole = stated_figures(asked).withColumns({"bound": any_stated(bound_schools(said, c("known"))), "found": any_stated(X.labelled(said))})

    def agrees(x: Column, value: Column, written: Column, needed: Column) -> Column:
        same = F.array_contains(x["values"], written) & F.forall(needed, lambda role: F.exists(x["found"], lambda y: (y["value"] == written) & (y["role"] == role)))
        place = (F.size(x["provinces"]) == 0) | F.coalesce(F.array_contains(x["provinces"], c("province")), F.lit(False))
        wrong_branch = (c("subjects").isin(*SCIENCE) & x["branch"]["arts"]) | (c("subjects").isin(*ARTS) & x["branch"]["science"])
        school = ~(c("cutoff") & (F.size("bound.names") > 0) & ~value.between(2000, 2099)) | F.exists("bound.names", lambda n: F.contains(x["fragment"], n))
        filed, major = F.contains(x["fragment"], F.lit(FILED)), F.contains(x["fragment"], F.lit(MAJOR))
        kind = ~(X.says(said, *MAJORS) & filed & ~major) & ~(F.contains(said, F.lit(FILED)) & major & ~filed)
        year = c("year").isNull() | (F.size(x["years"]) == 0) | F.array_contains(x["years"], c("year")) | F.arrays_overlap(X.asserted_years(said), x["years"]) | X.says(said, *X.HISTORY)
        return F.coalesce(same, F.lit(False)) & place & ~F.coalesce(wrong_branch, F.lit(False)) & school & kind & year

    def judged(value: Column) -> Column:
        needed = F.array_distinct(F.transform(F.filter("found", lambda x: x["value"] == value), lambda x: x["role"]))
        supported = X.named_once(needed, lambda needed: X.named_once(X.written(value), lambda written: F.exists("read", lambda x: agrees(x, value, written, needed))))
        verdict = F.when(c("sure") & c("bound.unbound"), "SCHOOL").when(supported, "SUPPORTED").otherwise("UNSUPPORTED")
        return F.struct(value.alias("value"), verdict.alias("verdict"))

    return whole.select("claim_id", "sentence", F.inline(F.transform("stated", judged)))


def admission_slots(messages: DataFrame) -> DataFrame:
    """Per room the conditions that its people supplied since the last fresh start, and which are missing. messages: conversation_id, sequence, speaker, text.

    A later mention replaces an earlier one and a later denial takes it back. Only rooms that ask for advice, and whose last word asks or follows up, have a row. No
    room is gathered: the last mention and the last denial of each value are kept.
    """
    human = messages.where("speaker = 'USER'").select("conversation_id", "sequence", "text")
    state = human.groupBy("conversation_id").agg(F.max_by("text", "sequence").alias("topic"), F.max(F.when(F.col("text").rlike(X.STARTS_ANEW), F.col("sequence"))).alias("anew"))
    live = human.join(state, "conversation_id").where("sequence >= coalesce(anew, sequence)")
    turns = F.col("topic").rlike(f"{X.ASKS}|{X.PROVINCES}|{X.FOLLOWS_UP}")
    rooms = live.groupBy("conversation_id").agg(F.bool_or(F.col("text").rlike(X.ASKS)).alias("asks"), F.bool_or(turns).alias("turns")).where("asks and turns").select("conversation_id")
    said = F.array(*[F.struct(F.lit(s).alias("slot"), X.supplied(F.col("text"), s).alias("found")) for s in X.SLOTS])
    each = live.select("conversation_id", "sequence", F.explode(said).alias("x")).select("conversation_id", "sequence", "x.slot", F.posexplode("x.found").alias("place", "m"))
    at = F.struct("sequence", "place")
    of_value = each.groupBy("conversation_id", "slot", F.col("m.value").alias("value")).agg(F.max(F.when(~F.col("m.negated"), at)).alias("said"), F.max(F.when(F.col("m.negated"), at)).alias("denied"))
    last = of_value.where("said is not null").groupBy("conversation_id", "slot").agg(F.max_by(F.struct("value", "said", "denied"), "said").alias("x"))
    kept = last.where("x.denied is null or x.denied < x.said").select("conversation_id", "slot", F.col("x.value").alias("value"))
    wide = rooms.join(kept, "conversation_id", "left").groupBy("conversation_id").agg(*[F.max(F.when(F.col("slot") == s, F.col("value"))).alias(s) for s in X.SLOTS])
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(s).isNull(), s) for s in X.SLOTS])), ",")
    return wide.withColumn("missing", missing)
