"""The queries of the text operators, and their DuckDB statements where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.llm import (
    divergence, gam, html_text, langid, lattice, licenses, mixing, multiset, secrets, simhash, spiece, topk, variants,
)
from stayrate.llm.common import fold, table
from stayrate.session import scratch_path

#: A published model file; read by the driver only.
TOKENIZER = os.environ.get("STAYRATE_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_quality_gam(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = gam.train(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    found = gam.scores(docs, model, keep=("doc_id", (fold("doc_id", 5) == 0).alias("held_out")))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op2_secret_ledger(spark, sf_dir):
    docs, ledger = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark, "ledger")
    secrets.update(docs, ledger)
    found = secrets.joined_back(docs, secrets.findings(spark, ledger)).select("doc_id", "spans")
    counts = [secrets.counted(F.col("spans"), r.kind).alias(f"n_{r.kind}") for r in secrets.BASE]
    base = secrets.written(F.col("spans"), secrets.BASE)
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"),
                        secrets.written(F.col("spans")).alias("spans"))


def _secrets_sql() -> str:
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    assign += r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    rules = [(r.kind, assign.replace("\\\\", "\\") if r.kind == "assign" else r.pattern, r.group, r.least)
             for r in secrets.RULES]
    hits = " union all ".join(
        f"select doc_id, {i} as place, '{kind}' as kind, {least} as least, regexp_extract_all(t, '{p}') as m, "
        f"regexp_extract_all(t, '{p}', {group}) as v, string_split_regex(t, '{p}') as gap from docs"
        for i, (kind, p, group, least) in enumerate(rules))
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in secrets.BASE)
    named = "kind || ':' || start || ':' || stop"
    return f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
hits as ({hits}),
each as (
    select doc_id, place, kind, least, m, gap, v, unnest(generate_series(1, len(m))) as i from hits where len(m) > 0),
spans as (
    select doc_id, place, kind, length(m[i]) as size,
        coalesce(list_sum(list_transform(gap[1:i], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as start
    from each where length(v[i]) >= least),
ends as (select *, start::bigint as a, (start + size)::bigint as b from spans),
named as (select doc_id, place, kind, a as start, b as stop from ends),
joined as (
    select doc_id, {counts},
        string_agg({named}, ',' order by start, place) filter (place < {len(secrets.BASE)}) as base,
        string_agg({named}, ',' order by start, place) as spans from named group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs d left join joined using (doc_id)"""


ORACLES["op2_secret_ledger"] = _secrets_sql()


@query
def op3_license_sentences(spark, sf_dir):
    found = licenses.recognised(table(spark, sf_dir, "documents"))
    known = F.filter("sentence_ids", lambda i: i != licenses.UNKNOWN)
    return found.select(
        "doc_id", F.array_join("licences", ",").alias("licences"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.size(known).cast("long").alias("n_known"),
        (F.size("sentence_ids") - F.size(known)).cast("long").alias("n_unknown"))


def _licenses_sql() -> str:
    normal = r"regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"
    keyword = f"regexp_matches({{}}, '{licenses.KEYWORD}')"
    known = ", ".join(f"('{name}', '{sentence}')" for name, sentence in licenses.SENTENCES.items())
    steps, last = [], "seq"
    for i, (name, names) in enumerate(licenses.RULES):
        parts = "".join(f"<{n}>" for n in names)
        steps.append(
            f"r{i} as (select doc_id, ids, replace(rest, '{parts}', '<>') as rest, case when contains(rest, '{parts}') "
            f"and not list_contains(found, '{name}') then list_append(found, '{name}') else found end as found from {last})")
        last = f"r{i}"
    return f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
known(name, sentence) as (values {known}),
marked as (select doc_id, regexp_replace(t, '([.!?])[ \t\n\x0B\f\r]+', '\1\x01', 'g') as t from docs
    where {keyword.format("t")}),
cut_up as (select doc_id, unnest(string_split(t, '\x01')) as s, generate_subscripts(string_split(t, '\x01'), 1) as i
    from marked),
whole as (select doc_id, i, s, {normal} as n from cut_up where {keyword.format("s")}),
pieces as (
    select doc_id, i, 0 as j, n from whole where n in (select sentence from known)
    union all
    select doc_id, i, j, {normal} as n from (
        select doc_id, i, unnest(string_split_regex(s, '\r\n|[\n\x0B\f\r]')) as s,
            generate_subscripts(string_split_regex(s, '\r\n|[\n\x0B\f\r]'), 1) as j
        from whole where n not in (select sentence from known)) where {keyword.format("s")}),
named as (select doc_id, list(coalesce(name, '?') order by i, j) as ids
    from pieces left join known on n = sentence group by doc_id),
seq as (select doc_id, ids, '<' || array_to_string(ids, '><') || '>' as rest, []::varchar[] as found from named),
{", ".join(steps)}
select d.doc_id, coalesce(array_to_string(found, ','), '') as licences,
    coalesce(array_to_string(ids, ','), '') as sentence_ids,
    coalesce(len(list_filter(ids, lambda x: x <> '?')), 0)::bigint as n_known,
    coalesce(len(list_filter(ids, lambda x: x = '?')), 0)::bigint as n_unknown
from docs d left join {last} using (doc_id)""".replace("'\x01'", "chr(1)").replace("\x01'", "' || chr(1)")


ORACLES["op3_license_sentences"] = _licenses_sql()


@query
def op4_entropy_mix(spark, sf_dir):
    found = mixing.mixed(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), most=3)
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op5_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_text.extracted(pages, html_text.train(pages))


@query
def op6_multiset_hash(spark, sf_dir):
    found = multiset.compared(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", multiset.text_of(F.col("fingerprint")).alias("fingerprint"),
        multiset.text_of(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op7_exact_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


ORACLES["op7_exact_topk"] = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as vec from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (
    select q.vec_id as query_id, c.vec_id, list_dot_product(q.vec, c.vec)::bigint as score
    from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""


@query
def op8_sentencepiece(spark, sf_dir):
    return spiece.round_trips(table(spark, sf_dir, "documents"), spiece.Pieces.load(TOKENIZER))


@query
def op9_simhash_near_copies(spark, sf_dir):
    found = simhash.near_copies(table(spark, sf_dir, "documents"), width=3, bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    learned = langid.profiles(docs.where(fold("doc_id", 4) != 2))
    return langid.identify(docs, learned, keep=("doc_id", (fold("doc_id", 4) == 2).alias("held_out")))


@query
def op11_spelling_variants(spark, sf_dir):
    found = variants.grouped(table(spark, sf_dir, "documents"), least_chars=6, least_n=5, ratio=5, slips=199)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


ORACLES["op11_spelling_variants"] = r"""
with recursive steps(b, k, c) as (
    select range, 0, range from range(256)
    union all select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8),
crc as (select list(c order by b) as t from steps where k = 8),
docs as (
    select coalesce(doc_id::varchar, '') as id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[A-Za-z\x{00C0}-\x{00FF}]+') as runs from documents),
each as (select id, unnest(runs) as run from docs),
counted as (select id, run, count(*) as n from each where length(run) >= 6 group by all),
bytes as (
    select id, run, n, list_concat([4294967295::bigint], list_transform(string_split(id, ''), x -> ascii(x)::bigint), [58::bigint],
        flatten(list_transform(string_split(run, ''), x -> case when unicode(x) < 128 then [unicode(x)::bigint]
            else [195::bigint, unicode(x)::bigint - 64] end))) as b from counted),
hashed as (
    select run, n, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[xor(a, x) & 255 + 1])), 4294967295) as h from bytes, crc),
slipped as (
    select n, case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end
        as word from hashed),
words as (
    select word, sum(n)::bigint as n from slipped where length(word) >= 6 group by word having sum(n) >= 5),
shorter as (
    select word, n, unnest(range(1, length(word) + 1)) as i, substr(word, 1, i - 1) || substr(word, i + 1) as left_over
    from words),
near as (
    select a.word, b.word as other, b.n as other_n from shorter a join shorter b using (i, left_over) where a.word <> b.word
    union select s.word, w.word, w.n from shorter s join words w on s.left_over = w.word
    union select w.word, s.word, s.n from shorter s join words w on s.left_over = w.word),
best as (
    select word, count(*) as n_near, arg_max(other, (other_n, -place)) as other, max(other_n) as other_n
    from (select *, row_number() over (partition by word order by encode(other)) as place from near) group by word),
named as (
    select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * w.n then other end as form,
        case when other_n >= 5 * w.n then other_n end as form_n from words w left join best using (word)),
chain(word, root, depth) as (
    select word, word, 0 from named
    union all select c.word, n.form, depth + 1 from chain c join named n on c.root = n.word where n.form is not null)
select n.word, form, root, n, n_near, form_n from named n
join (select word, arg_max(root, depth) as root from chain group by word) using (word)""".replace(
    "x -> ", "lambda x: ").replace("& 255 + 1]", "& 255) + 1]").replace("t[xor(a, x)", "t[(xor(a, x)")


@query
def op12_source_divergence(spark, sf_dir):
    return divergence.audited(table(spark, sf_dir, "documents"), least_docs=10, top=10)


ORACLES["op12_source_divergence"] = r"""
with docs as (
    select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
each as (select row_id, lang, source, unnest(terms) as term from docs),
counts as (select lang, source, term, count(*)::hugeint as n, count(distinct row_id) as docs from each group by all),
kept as (select lang, term, sum(n) as n from counts group by all having sum(docs) >= 10),
sizes as (select lang, count(*)::hugeint as v, sum(n) as total from kept group by lang),
cells as (select c.lang, c.source, c.term, c.n from counts c join kept k using (lang, term)),
groups as (
    select g.lang, g.source, coalesce(v, 0) as v, coalesce(s.total, 0) as lang_total, coalesce(t.total, 0) as total
    from (select distinct lang, source from docs) g left join sizes s using (lang)
    left join (select lang, source, sum(n) as total from cells group by all) t using (lang, source)),
rates as (
    select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * v) as p,
        1 + 1000000000 * (k.n + 2) // (lang_total + 2 * v) as q
    from groups g join kept k using (lang) left join cells c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
    select a.lang, a.source, 'pair' as part, b.source as item,
        coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::bigint as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join rates x on x.lang = a.lang and x.source = a.source
    left join rates y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
terms as (
    select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from rates
    where n > 0 and p > q),
ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, encode(item))::int as rank
    from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= 10"""


@query
def op13_lattice_near_copies(spark, sf_dir):
    return lattice.near_copies(table(spark, sf_dir, "embeddings"), least=0.95)


ORACLES["op13_lattice_near_copies"] = """
with recursive v as (
    select row_number() over () as i, vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
usable as (
    select i, vec_id, e from v where vec_id is not null and e is not null
    and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (
    select a.i, b.i as j from usable a join usable b on a.i <> b.i and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= 0.95),
reached(i, j) as (select i, i from usable union select r.i, l.j from reached r join links l on r.j = l.i),
least as (select r.i, min(u.vec_id) as component_id from reached r join usable u on r.j = u.i group by r.i),
degree as (select i, count(*) as n_links from links group by i)
select vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(component_id, vec_id) as component_id,
    coalesce(vec_id = coalesce(component_id, vec_id), false) as kept
from v left join least using (i) left join degree using (i)"""
