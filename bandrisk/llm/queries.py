"""One query per operator on the test tables, and SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandrisk.llm import (
    ann,
    decontaminate,
    html_extract,
    langid,
    packing,
    pii,
    prefix_trie,
    repair,
    sharding,
    simhash,
    substring,
    toxicity,
    url_filter,
)
from bandrisk.sources.store import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_boosted_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    forest = html_extract.train(html_extract.sample_words(pages))
    return html_extract.extract(pages, forest).select("page_id", "url", "text", "n_chars")


def op2_small_world_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"), Scratch(spark))


def op3_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    marked = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    categories = ("low_quality", "toxic")
    chain = toxicity.train_on(docs, marked, categories)
    return toxicity.predict(docs.select("doc_id", "text"), chain, categories).drop("text")


def op4_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages"), Scratch(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), Scratch(spark))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_recurrent_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.train_on(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring.remove_repeated(docs)
    return cut.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op8_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(packing.pack_documents(_table(spark, sf_dir, "documents")))


def op9_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = decontaminate.contaminated(docs, items, Scratch(spark))
    return found.select("doc_id", "item_id", "shared", "item_shingles", "containment")


def op10_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"), Scratch(spark))
    return placed.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# Conversations in a family, whose first one lends its beginning to the others, and the lengths it lends.
FAMILY, LENT = 5, 9


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, turns`` with the beginning of each conversation taken from the first of its family, if there is one."""
    head = F.col("conv_id") - F.col("conv_id") % FAMILY
    families = turns.groupBy(head.alias("head")).agg(
        F.max(F.when(F.col("conv_id") == head, F.col("turns"))).alias("lender"),
        F.collect_list(F.struct("conv_id", "turns")).alias("members"),
    )
    members = families.select("lender", F.inline("members"))
    lent = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT).cast("int")
    own = F.slice("turns", lent + 1, F.greatest(F.size("turns"), F.lit(1)))
    begun = F.slice(F.coalesce("lender", F.array().cast("array<binary>")), F.lit(1), lent)
    return members.select("conv_id", F.concat(begun, own).alias("turns"))


def op11_radix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.conversation_turns(_table(spark, sf_dir, "conversations"))
    nodes = prefix_trie.prefix_trie(rebuilt(turns), Scratch(spark))
    return nodes.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved_bytes").alias("saved_tokens"),
        "ends_sha256",
    )


def op12_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(pii.sample_words(docs)))

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("_spans", lambda s: s["strict"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("_spans")).alias("spans")
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with one of five faults in a quarter of them, chosen by conversation and turn; NULL is a space."""
    space = F.lit(" ")
    parts = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
        (F.crc32(F.concat_ws(":", *parts).cast("binary")) % 20).alias("fault"),
    )
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def op13_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    found = repair.repair(damaged(conversations), Scratch(spark), ids=conversations)
    faults = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select("conv_id", *faults, "audit", "repaired_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_boosted_dom": op1_boosted_dom,
    "op2_small_world_search": op2_small_world_search,
    "op3_classifier_chain": op3_classifier_chain,
    "op4_redirect_equivalence": op4_redirect_equivalence,
    "op5_simhash_balls": op5_simhash_balls,
    "op6_recurrent_langid": op6_recurrent_langid,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_first_fit_packing": op8_first_fit_packing,
    "op9_minhash_containment": op9_minhash_containment,
    "op10_histogram_sort": op10_histogram_sort,
    "op11_radix_trie": op11_radix_trie,
    "op12_candidate_boosting": op12_candidate_boosting,
    "op13_lightest_repair": op13_lightest_repair,
}

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sets(table: str, name: str) -> str:
    """Different five-word shingles of each row, as SQL."""
    tokens = _WORDS.format(text=_LOWER.format(text="text"))
    return f"""
        select distinct {name}, md5(text) as mark, unnest(case
            when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as shingle
        from (select {name}, text, {tokens} as w from {table} where text is not null)"""


# Every window of 35 words as text; the words that a repeated one covers; what is left.
_SUBSTRING = rf"""
with d as (select row_number() over () as r, doc_id, {_WORDS.format(text="coalesce(text, '')")} as w from documents),
win as (
  select r, s, md5(array_to_string(w[s:s + 34], ' ')) as mark
  from (select r, w, unnest(range(1, len(w) - 33)) as s from d)
), starts as (
  select r, s from win semi join (select mark from win group by mark having count(*) > 1) m using (mark)
), covered as (select distinct r, s + unnest(range(0, 35)) as pos from starts),
word as (select r, unnest(w) as word, generate_subscripts(w, 1) as pos from d),
cut as (
  select r, count(c.pos) as n_removed, string_agg(word, ' ' order by pos) filter (where c.pos is null) as kept
  from word left join covered c using (r, pos) group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join cut using (r)"""


def _rule(host: str, path: str, answer: int) -> str:
    """The longest fitting rule (0) or its verdict (1), as SQL."""
    cases = ""
    for rule in sorted(url_filter.RULES, key=lambda r: -len(r[0])):
        name, _, start = rule[0].partition("/")
        fits = f"({host} = '{name}' or ends_with({host}, '.{name}')) and starts_with({path}, '/{start}')"
        cases += f" when {fits} then '{rule[answer]}'"
    return f"case{cases} end"


def _url(url: str, part: str) -> str:
    """``host``, ``path`` or ``node`` of a URL, as SQL."""
    found = {
        "host": r"(?s)^.*?://([^/?#]*)",
        "path": r"(?s)^.*?://[^/?#]*([^?#]*)",
        "rest": r"(?s)^.*?://[^/?#]*([^#]*)",
    }
    if part == "node":
        host = _url(url, "host")
        return f"case when {host} <> '' then {host} || {_url(url, 'rest')} end"
    value = f"regexp_extract(coalesce({url}, ''), '{found[part]}', 1)"
    return _LOWER.format(text=value) if part == "host" else value


_TAG_ATTRIBUTES = ("rel", "http-equiv", "content", "href")


def _tag_value(name: str) -> str:
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    value = " || ".join(f"regexp_extract(tag, '{pattern}', {n})" for n in (1, 2, 3))
    return f"trim(regexp_replace({value}, '(?i)&amp;', '&', 'g'))"


_URLS = rf"""
with recursive p as (select *, {_url("url", "host")} as host, {_url("url", "path")} as path, {_url("url", "node")} as node from pages),
tags as (
  select url, {", ".join(f'{_tag_value(n)} as a{k}' for k, n in enumerate(_TAG_ATTRIBUTES))}
  from (select url, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script', '', 'g'), '(?is)<style\b.*?</style', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) as tag from pages where url is not null)
), hrefs as (
  select url, trim(case when regexp_matches(lower(a0), '(^|\s)canonical(\s|$)') then a3
    when lower(a1) = 'refresh' then regexp_extract(a2, '(?is)url\s*=\s*[''"]?([^''"]*)', 1) end) as href,
    regexp_extract(url, '(?s)^(.*?)://', 1) as scheme, regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) as host,
    regexp_extract({_url("url", "path")}, '(?s)^(.*/)', 1) as folder
  from tags
), targets as (
  select url, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') then href when starts_with(href, '//') then scheme || ':' || href
    when starts_with(href, '/') then scheme || '://' || host || href
    else scheme || '://' || host || case when folder = '' then '/' else folder end || href end as target
  from hrefs where href <> ''
), links as (select {_url("url", "node")} as u, {_url("target", "node")} as v from targets),
edges as (select u, v from links where u is not null and v is not null union select v, u from links where u is not null and v is not null),
reach as (select u, v from edges union select r.u, e.v from reach r join edges e on r.v = e.u),
owned as (select u, {_rule("regexp_extract(v, '(?s)^([^/?#]*)', 1)", "regexp_extract(v, '(?s)^[^/?#]*([^?#]*)', 1)", 1)} as own from reach),
inherited as (select u from owned group by u having bool_or(coalesce(own, '') = 'block') and not bool_or(coalesce(own, '') = 'allow'))
select page_id, host, path, {_rule("host", "path", 0)} as rule,
  coalesce({_rule("host", "path", 1)}, case when node in (select u from inherited) then 'block' end, 'allow') as verdict
from p"""

def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit, as SQL."""
    octets = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda a, e: {step}), 4294967295)"


# Every beginning of every rebuilt conversation as a list of turns, and every pair of one and a longer one.
_TRIE = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), o as (
  select conv_id, list(struct_pack(role := role, text := text)
    order by turn nulls first, sha256(strlen(role) || ':' || role || text)) as w
  from t group by conv_id
), r as (
  select o.conv_id, list_concat(coalesce(b.w, [])[1:h], o.w[h + 1:]) as w
  from (select *, ({_crc32("conv_id::varchar")} % {LENT})::int as h from o) o
  left join o b on b.conv_id = o.conv_id - o.conv_id % {FAMILY}
), p as (select conv_id, len(w) as n, unnest(range(0, len(w) + 1)) as depth, w from r),
n as (
  select depth, w[1:depth] as w, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = depth), '')) as ends_sha256
  from p group by all
), kids as (select depth - 1 as depth, w[1:depth - 1] as w, count(*) as n from n where depth > 0 group by all),
k as (select n.*, coalesce(kids.n, 0) as n_children from n left join kids using (depth, w)),
up as (select *, unnest(range(0, depth + 1)) as place from k),
below as (
  select place as depth, w[1:place] as w, count(*) filter (where n_children = 0) as n_leaves,
    sum((n_convs - 1) * case when depth > 0 then strlen(w[depth].text) else 0 end) as saved
  from up group by all
)
select k.conv_id, k.depth, above.conv_id as parent_conv_id, k.n_convs, k.n_children, below.n_leaves,
  below.saved::bigint as saved_tokens, k.ends_sha256
from k join below using (depth, w) left join k above on above.depth = k.depth - 1 and above.w = k.w[1:k.depth - 1]"""

# The cheapest edits row by row: for every number of rows and last role the least cost, then letters. Two
# inserts in one place are the most that can pay.
_REPAIR = rf"""
with recursive c as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {_crc32("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as fault
  from conversations
), d as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case fault when 3 then [1, 2] else [1] end) as copy
  from c where fault <> 0
), n as (
  select *, left(role, 1) as initial, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank,
    row_number() over (partition by conv_id order by turn nulls first, role,
      sha256(strlen(role) || ':' || role || text), copy) as i
  from d
), m as (
  select *, not blank and row_number() over (partition by conv_id, role, text order by i) > 1 as duplicate,
    lag(initial) over (partition by conv_id order by i) || initial as pair
  from n
), f as (
  select *, not blank and not duplicate
    and regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') as truncated
  from m
), faults as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (where blank) as blank, count(*) filter (where duplicate) as duplicate,
    count(*) filter (where truncated) as truncated,
    count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal, count(*) as n
  from f group by conv_id
), t(before, role, after) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
gap(before, after, price, letters) as (
  select distinct before, before, 0, '' from t
  union all select before, after, 3, 'I' from t where role <> 's'
  union all select a.before, b.after, 6, 'II' from t a join t b on a.after = b.before where a.role <> 's'
), edit as (
  select conv_id, i, before, before as after, 4 as price, 'D' as letter from f, (select distinct before from t)
  union all select conv_id, i, before, after, 3 * truncated::int, 'K' from f join t on t.role = initial
    where not blank and not duplicate
  union all select conv_id, i, before, after, 3 + 3 * truncated::int, 'R' from f join t on t.role <> 's'
    where not blank and not duplicate
), walk(conv_id, i, state, best) as (
  select conv_id, 0::bigint, after, struct_pack(cost := price, audit := letters)
  from faults, gap where before = 0
  union all
  select w.conv_id, w.i + 1, g.after,
    min(struct_pack(cost := w.best.cost + e.price + g.price, audit := w.best.audit || e.letter || g.letters))
  from walk w join edit e on e.conv_id is not distinct from w.conv_id and e.i = w.i + 1 and e.before = w.state
  join gap g on g.before = e.after
  group by w.conv_id, w.i, g.after
), least as (
  select a.*, (select min(best) from walk w where w.conv_id is not distinct from a.conv_id and w.i = a.n and state in (0, 3)) as best
  from faults a
), letter as (
  select conv_id, generate_subscripts(l, 1) as pos, unnest(l) as letter
  from (select conv_id, string_split(best.audit, '') as l from least where best.audit <> '')
), placed as (
  select *, count(*) filter (where letter <> 'I') over w as i, count(*) filter (where letter <> 'D') over w as made
  from letter window w as (partition by conv_id order by pos)
), made as (
  select p.*, f.role, f.text, max(case when p.made = 1 and letter = 'K' and initial = 's' then 1 else 0 end)
    over (partition by p.conv_id) as system
  from placed p left join f on f.conv_id is not distinct from p.conv_id and f.i = p.i
  where letter <> 'D'
), repaired as (
  select conv_id, sha256(string_agg(case letter when 'K' then role
      else case (made - system) % 2 when 1 then 'user' else 'assistant' end end || ':'
    || case letter when 'I' then '' else text end, chr(10) order by pos)) as mark
  from made group by conv_id
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.cost, 0)::bigint as cost,
  coalesce(best.audit, '') as audit, coalesce(mark, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join least l on l.conv_id is not distinct from o.conv_id
left join repaired r on r.conv_id is not distinct from o.conv_id"""

ORACLE: dict[str, str] = {
    "op13_lightest_repair": _REPAIR,
    "op11_radix_trie": _TRIE,
    "op4_redirect_equivalence": _URLS,
    "op7_substring_dedup": _SUBSTRING,
    "op9_minhash_containment": f"""
        with d as ({_sets("documents", "doc_id")}), i as ({_sets("benchmark", "item_id")}),
        n as (select item_id, mark, count(*) as total from i group by all),
        s as (select d.doc_id, d.mark as doc_mark, i.item_id, i.mark, count(*) as shared
              from d join i using (shingle) group by all)
        select distinct doc_id, item_id, shared::int as shared, total::int as item_shingles,
               shared::double / total::double as containment
        from s join n using (item_id, mark) where shared >= ceil(total * 0.8::double - 1e-9)""",
}
