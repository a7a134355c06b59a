"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}_]+)"
#: First matching list decides. Fixed values.
CLAIMS = (
    ("ASPIRATION", ("我希望", "我想成为", "我想更", "我愿意成为", "我打算")),
    ("NEEDS_REVIEW", ("他说", "她说", "朋友说", "假如", "假设", "小说", "故事里")),
    ("SELF_REPORT", ("我认为自己", "我觉得自己", "我是一个", "我喜欢", "我不喜欢")),
)
#: Keys; addresses of mail, mobile telephone numbers and identity numbers.
SECRET = r"(?U)(?i)(?:sk-|tvly-|Bearer\s+)\S{8,}|\b[A-Za-z0-9_-]{32,}\b"
PRIVATE = r"(?U)[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|(?<!\d)1[3-9]\d{9}(?!\d)|(?<!\d)\d{17}[\dXx](?!\d)"
#: Ends of lines as Python's str.splitlines has them, white space at a line's ends, ends of sentences.
LINES, EDGES, SENTENCES = r"\R|[\x1c-\x1e]", r"\A[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+\z", r"(?<=[。！？.!?])\s*"


def trimmed(text: Column) -> Column:
    """text without white space of any kind at its ends, as Python's str.strip() has it."""
    return F.regexp_replace(text, EDGES, "")


def folded(text: Column) -> Column:
    """Lower case, with ß as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(WORD), 1)


def terms(text: Column) -> Column:
    """Distinct words of a text."""
    return F.array_distinct(words(text))


def names(text: Column) -> Column:
    """Long words in capitals, as they stand: names, mostly."""
    return F.regexp_extract_all(text, F.lit(r"(\p{Lu}[\p{L}\p{N}_]{7,})"), 1)


def normalised(text: Column) -> Column:
    """Words only, joined: for comparing questions."""
    return F.regexp_replace(folded(text), r"[^\p{L}\p{N}_]", "")


def kept_words(text: Column) -> Column:
    """Words only, joined, in the case in which they stand."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_]", "")


def byte_estimate(text: Column, around: int = 256) -> Column:
    """A bound on tokens that holds for any tokenizer: a token a byte, and what goes around the text."""
    return (F.octet_length(text) + around).cast("long")


def wide_characters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x00-\x7f]", ""))


def estimated_tokens(text: Column, messages: Column | int = 1) -> Column:
    """1.5 for a wide character, a third for any other, 8 for a message, 96 for the call."""
    wide, n = wide_characters(text), F.lit(messages) if isinstance(messages, int) else messages
    return F.floor(wide * 1.5 + (F.length(text) - wide) / 3).cast("long") + n * 8 + 96


def claim_kind(text: Column, lists: tuple = CLAIMS, otherwise: str = "OBSERVATION") -> Column:
    out = F.lit(otherwise)
    for kind, phrases in reversed(lists):
        found = F.lit(False)
        for p in phrases:
            found = found | F.contains(text, F.lit(p))
        out = F.when(found, kind).otherwise(out)
    return out


def redacted(text: Column, limit: int, secret: str = "[hidden]", private: str = "[private]") -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, SECRET, secret), PRIVATE, private), 1, limit)


def preview(text: Column, size: int = 100) -> Column:
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, size)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


#: Parts of an address: scheme, who logs in, host (IPv6 in brackets), port, path, query, fragment. Names that never leave a house, addresses that are not public, fields that
#: carry keys. Fixed values.
URL = r"\A(https?)://(?:([^/?#@]*)@)?(\[[0-9A-Fa-f:.]+\]|[^/?#@:\[\]]+)(?::(\d*))?([^?#]*)(\?[^#]*)?(#.*)?\z"
HOUSE = r"(?i)\A(?:localhost|metadata\.google\.internal)\z|\.(?:localhost|local|internal|lan|home|invalid)\z"
NOT_PUBLIC = (
    r"\A(?:0|10|127|2[4-5]\d)\.|\A100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|\A169\.254\.|\A172\.(?:1[6-9]|2\d|3[01])\.|\A192\.(?:168|0\.[02])\.|\A198\.(?:1[89]|51\.100)\.|\A203\.0\.113\.|"
    r"(?i)\A\[(?![23][0-9a-f]{3}:)|\A\[2001:db8:"
)
CARRIES_KEYS = r"(?i)(?:^|[?&;])(?:api[_-]?key|access[_-]?token|token|password|authorization|signature)="
LONGEST_URL = 2048


def public_url(url: Column) -> Column:
    """An address on the open web without its fragment, null if it is none: another scheme or port, a login, a name or number of a house network, or something private in it.

    Names are not resolved, so one that leads to a private address passes.
    """
    part = lambda k: F.regexp_extract(url, URL, k)
    name = F.lower(F.regexp_replace(part(3), r"\.+\z", ""))
    plain = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    four = name.rlike(r"\A\d{1,3}(?:\.\d{1,3}){3}\z")
    bad = (
        (F.length(url) > LONGEST_URL) | url.rlike(r"[\x00-\x20\\]") | ~url.rlike(URL) | url.rlike(r"\Ahttps?://[^/?#]*@") | ~part(4).isin("", "80", "443") | (name == "")
        | plain.rlike(PRIVATE) | part(6).rlike(CARRIES_KEYS) | name.rlike(HOUSE) | ~name.rlike(r"[.:]") | ((four | name.startswith("[")) & name.rlike(NOT_PUBLIC))
    )
    path = F.when(part(5) == "", "/").otherwise(part(5))
    port = F.regexp_extract(url, r"\Ahttps?://(?:\[[^\]]*\]|[^/?#:\[]*)(:\d*)", 1)
    return F.when(~bad, F.concat(part(1), F.lit("://"), part(3), port, path, F.when(part(6) == "?", "").otherwise(part(6))))


def official(name: Column) -> Column:
    return name.rlike(r"\.(gov\.cn|edu\.cn|gov|edu)$")


def years(text: Column) -> Column:
    """Years from 2000 on, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(20\d\d)\b"), 1))), ",")


def numbers(text: Column) -> Column:
    """Distinct numbers with thousands separators and the multipliers 万 and 千, as decimals."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\d.])(\d[\d,，]*(?:\.\d+)?\s*[万千]?)"), 1)

    def value(x: Column) -> Column:
        times = F.when(x.rlike("万$"), 10000).when(x.rlike("千$"), 1000).otherwise(1)
        return F.regexp_replace(x, r"[,，\s万千]", "").try_cast("decimal(28,8)") * times

    return F.array_distinct(F.filter(F.transform(found, value), lambda x: x.isNotNull()))


def query_refusal(query: Column) -> Column:
    """Why a search query may not leave, null if it may."""
    q = trimmed(query)
    return (
        F.when(q.isNull() | ~F.length(q).between(2, 300), "LENGTH")
        .when(q.rlike(r"[\x00-\x1f]") | q.rlike(SECRET) | q.rlike(PRIVATE) | q.rlike(r"(?i)(?:api[ _-]*key|密钥|密码|authorization)\s*[:=：]\s*\S+"), "PRIVATE")
        .when(q.rlike(r"(?i)(?:https?|file|ftp|data|javascript)://"), "ADDRESS")
    )


def excerpt(text: Column, limit: int = 4200) -> Column:
    """Whole lines, of overlong lines whole sentences, as far as they fit: what does not fit is passed over. Blank lines between shrink to one."""
    lines = F.transform(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\0")), LINES), lambda x: F.regexp_replace(x, EDGES, ""))
    parts = F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > limit, F.array_remove(F.split(x, SENTENCES), "")).otherwise(F.array(x))))
    start = F.struct(F.lit("").alias("out"), F.lit(limit).alias("room"), F.lit("").alias("gap"))  # gap: what goes before the next part

    def step(a: Column, x: Column) -> Column:
        fits = F.length(x) < a["room"]
        more = F.struct(F.concat(a["out"], a["gap"], x).alias("out"), (a["room"] - F.length(x) - 1).alias("room"), F.lit("\n").alias("gap"))
        blank = F.struct(a["out"].alias("out"), a["room"].alias("room"), F.when(a["out"] == "", "").otherwise("\n\n").alias("gap"))
        return F.when(x == "", blank).when(fits, more).otherwise(a)

    return F.aggregate(parts, start, step)["out"]


#: Fields of a reply envelope; the longest envelope and part. Fixed values.
ENVELOPE, LONGEST_ENVELOPE, LONGEST_PART = ("messages", "idle_followup", "expects_reply"), 64_000, 12_000


def envelope(text: Column, most: int = 4) -> Column:
    """A reply as (parts, followup, awaits, refused): the first rule that an envelope breaks refuses it; what is no envelope is one part as it stands.

    parts and followup are raw text; a followup of a reply that awaits an answer is still there.
    """
    bare = trimmed(F.regexp_replace(trimmed(F.coalesce(text, F.lit(""))), r"\A\uFEFF+", ""))
    body = trimmed(F.regexp_replace(bare, r"(?is)\A```(?:json)?\s*\n?(\s*[{\[].*?)\n?```\z", "$1"))
    value = F.try_parse_json(body)
    field = lambda name, kind: F.try_variant_get(value, f"$.{name}", kind)
    shape = lambda name: F.coalesce(F.schema_of_variant(field(name, "variant")), F.lit("VOID"))
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    ours = F.array(*map(F.lit, ENVELOPE))
    parts, later = field("messages", "array<string>"), field("idle_followup", "string")
    fine = lambda x: (F.length(trimmed(x)) > 0) & (F.length(x) <= LONGEST_PART)
    jsonlike, known = body.rlike(r"^[{\[]"), F.arrays_overlap(keys, ours)
    rules = (
        F.when((body == "") | (F.length(text) > LONGEST_ENVELOPE), "EMPTY")
        .when(~jsonlike, F.when(body.rlike(r'\{\s*"(?:' + "|".join(ENVELOPE) + r')"\s*:'), "UNFINISHED").otherwise("PLAIN"))
        .when(value.isNull(), "UNFINISHED")
        .when(body.startswith("{") & ~known, "PLAIN")
        .when(body.startswith("[") | (F.size(F.array_except(keys, ours)) > 0), "FORM")
        .when((shape("messages") != "ARRAY<STRING>") | ~shape("idle_followup").isin("STRING", "VOID") | ~shape("expects_reply").isin("BOOLEAN", "VOID"), "CONTENT")
        .when(F.array_contains(keys, "expects_reply") & (shape("expects_reply") == "VOID"), "CONTENT")
        .when(~(F.size(parts) + later.isNotNull().cast("int")).between(1, most) | (F.size(parts) == 0), "CONTENT")
        .when(~F.forall(parts, lambda x: F.coalesce(fine(x), F.lit(False))) | ~F.coalesce(fine(later), F.lit(True)), "CONTENT")
    )
    verdict = F.element_at(F.transform(F.array(rules), lambda r: r), 1)
    out = lambda p, f, a, r: F.struct(p.cast("array<string>").alias("parts"), f.cast("string").alias("followup"), a.alias("awaits"), r.cast("string").alias("refused"))
    nothing = F.lit(None)
    return (
        F.when(verdict == "PLAIN", out(F.array(text), nothing, F.lit(False), nothing))
        .when(verdict.isNotNull(), out(F.array(), nothing, F.lit(False), verdict))
        .otherwise(out(parts, later, F.coalesce(field("expects_reply", "boolean"), F.lit(False)), nothing))
    )


def dialogue_batch(replies: DataFrame, text: str, most: int = 4) -> DataFrame:
    """replies with parts and followup as plain text, and refused. There is no followup where an answer is awaited or the last part asks."""
    from tessera.functions.udfs import markdown_plain_each

    read = replies.withColumn("_read", envelope(F.col(text), most))
    plain = read.withColumn("parts", markdown_plain_each("_read.parts")).withColumn("_later", markdown_plain_each(F.array("_read.followup"))[0])
    asks = F.coalesce(F.try_element_at("parts", F.lit(-1)).rlike(r"[？?][\s\"'”’）)]*$"), F.lit(False))
    later = F.when(F.col("_read.followup").isNotNull() & ~F.col("_read.awaits") & ~asks, F.col("_later"))
    return plain.select(*[c for c in replies.columns if c not in ("parts", "followup", "refused")], "parts", later.alias("followup"), F.col("_read.refused").alias("refused"))


#: Most queries of one search, and the longest. Fixed values.
MOST_QUERIES, LONGEST_QUERY = 3, 300


def agent_action(text: Column) -> Column:
    """A reply as (action, queries, reply, refused): SEARCH with its distinct queries, REPLY or CLARIFY with the reply's JSON, or the text as it stands as a REPLY.

    What is JSON without an action is no envelope; one that is cut off is UNFINISHED, a search with wrong queries is QUERIES, any other action or field is NOT_ALLOWED, a null is EMPTY.
    """
    bare = trimmed(F.regexp_replace(trimmed(text), r"\A\uFEFF+", ""))
    body = trimmed(F.regexp_replace(bare, r"(?i)\A```(?:json)?\s*\n?([\s\S]*?)\n?```\z", "$1"))
    value = F.try_parse_json(body)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit("VOID"))
    keys = F.array_sort(F.coalesce(F.json_object_keys(body), F.array().cast("array<string>")))
    action, asked = F.try_variant_get(value, "$.action", "string"), F.try_variant_get(value, "$.queries", "array<string>")
    only = lambda *names: keys == F.array(*map(F.lit, sorted(names)))
    fine = F.forall(asked, lambda q: (F.length(trimmed(q)) > 0) & (F.length(q) <= LONGEST_QUERY))
    searches = only("action", "queries") & (kind("$.queries") == "ARRAY<STRING>") & F.size(asked).between(1, MOST_QUERIES) & fine
    replies = action.isin("REPLY", "CLARIFY") & only("action", "reply") & kind("$.reply").startswith("OBJECT")
    nothing, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    out = lambda a, q, r, x: F.struct(a.alias("action"), q.alias("queries"), r.alias("reply"), x.alias("refused"))
    plain = out(F.lit("REPLY"), none, text, nothing)
    refused = lambda why: out(nothing, none, nothing, F.lit(why))
    return (
        F.when(text.isNull(), refused("EMPTY"))
        .when(value.isNull() & body.rlike(r'\{\s*"action"\s*:'), refused("UNFINISHED"))
        .when(value.isNull() | ~F.coalesce(F.array_contains(keys, "action"), F.lit(False)), plain)
        .when((action == "SEARCH") & (kind("$.action") == "STRING"), F.when(F.coalesce(searches, F.lit(False)), out(action, F.array_distinct(F.transform(asked, trimmed)), nothing, nothing)).otherwise(refused("QUERIES")))
        .when(F.coalesce(replies, F.lit(False)), out(action, none, F.to_json(F.try_variant_get(value, "$.reply", "variant")), nothing))
        .otherwise(refused("NOT_ALLOWED"))
    )


def canonical_json(text: Column) -> Column:
    """JSON with the keys of all objects in order of their code points and no blanks between; null if it is none. Numbers keep their kind: whole ones stay whole."""
    return F.to_json(F.try_parse_json(text))


def digest(text: Column) -> Column:
    """SHA-256 of a JSON text's canonical form: the same for equal values, however they are written."""
    return F.sha2(canonical_json(text), 256)


#: What a profile's text must not carry: fields and commands of a runtime, installs, demands on rules or keys. Fixed value.
RUNTIME_MARKERS = (
    r"(?im)(?:^\s*(?:allowed-tools|run|scripts|tools)\s*:|\b(?:WebSearch|WebFetch|curl|wget|subprocess|os\.system)\b|"
    r"\b(?:npx\s+skills|pip\s+install|npm\s+install|git\s+clone)\b|自动(?:联网|执行|安装)|忽略.{0,15}(?:系统|前述|隐私|权限|规则)|(?:读取|导出|打印|发送).{0,15}(?:全部记忆|所有记忆|API.?key|密钥|密码))"
)
#: Fields of a profile's front matter, the longest value. Fixed values.
FRONT, LONGEST_FRONT = ("name", "description", "version", "license", "author"), 500
#: The largest profile, in bytes. Fixed value.
LARGEST_PROFILE = 64 * 1024


def runtime_markers(text: Column) -> Column:
    """Whether a text carries what only a runtime may have. It helps to turn texts down; it grants nothing."""
    return text.rlike(RUNTIME_MARKERS)


def front_matter(text: Column) -> Column:
    """(fields, refused) of a profile's text: the known fields of its front matter, none where it has none; SIZE, TEXT (a null character) or OPEN (front matter that does not end)."""
    head = F.regexp_extract(text, r"(?s)\A---(.*?)---", 1)
    lines = F.filter(F.split(head, LINES), lambda x: x.rlike(rf"\A(?:{'|'.join(FRONT)}):\s*\S.{{0,{LONGEST_FRONT - 1}}}\z"))
    name = lambda x: F.regexp_extract(x, r"\A(\w+):", 1)
    value = lambda x: F.regexp_replace(F.regexp_replace(x, r"\A\w+:\s*", ""), r"\A[\"']+|[\"']+\z", "")
    last = F.aggregate(lines, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != name(x)), F.create_map(name(x), value(x))))
    opened = text.startswith("---")
    refused = F.when(F.octet_length(text) > LARGEST_PROFILE, "SIZE").when(F.contains(text, F.lit("\0")), "TEXT").when(opened & ~text.rlike(r"(?s)\A---.*?---"), "OPEN")
    return F.struct(F.when(refused.isNull() & opened, last).otherwise(F.create_map().cast("map<string,string>")).alias("fields"), refused.alias("refused"))


def fenced_object(text: Column) -> Column:
    """The JSON object of a reply, fenced or not, in canonical form; null if it holds none."""
    bare = trimmed(text)
    body = F.when(bare.startswith("```"), F.regexp_replace(bare, r"\A```(?:json)?\s*|\s*```\z", "")).otherwise(bare)
    value = F.try_parse_json(body)
    return F.when(F.coalesce(F.schema_of_variant(value), F.lit("VOID")).startswith("OBJECT"), F.to_json(value))


def score(value: Column, path: str = "$") -> Column:
    """A number of 0 to 100 at a path of a variant; null for anything else, true and false and numbers in quotes among it."""
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit("VOID"))
    number = F.try_variant_get(value, path, "double")
    return F.when(kind.rlike(r"^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)") & number.between(0, 100) & ~F.isnan(number), number)


def part_delay(text: Column, low: float, high: float, per_second: float = 90.0) -> Column:
    """Seconds before the next part of a reply is shown: longer for a longer text, within bounds."""
    return F.least(F.lit(high), F.greatest(F.lit(low), low + F.length(text) / per_second))


def recent_label(at: Column, now: Column) -> Column:
    """The hour of an instant of today, else month and day; empty without one."""
    return F.when(at.isNull(), "").when(F.to_date(at) == F.to_date(now), F.date_format(at, "HH:mm")).otherwise(F.date_format(at, "M/d"))
