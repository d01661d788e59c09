"""Every query by name, with its DuckDB equivalent where SQL can express it.

The data has no packages, so roles are bound to tables: ``benchmark`` items are source pages (one document of ordered pages), ``documents`` are the derived
text, ``pages`` the content documents, ``conversations`` and ``events`` the logs. Where the data would make a query pass without
a real case, the input is shaped in the query, in the same way in both languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import core
from ..core import table
from ..functions import markup
from ..functions import text as T
from ..operators import fidelity, package, shaping
from ..sources import epub
from . import jobs, library, report

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- pieces of SQL that several oracles share
_NORM = r"replace(lower(trim(regexp_replace(regexp_replace({0}, '(\w)-\s*\n\s*(\w)', '\1\2', 'g'), '\s+', ' ', 'g'))), 'ß', 'ss')"


def _norm(c: str) -> str:
    return _NORM.format(c)


def _words(c: str) -> str:
    return f"list_filter(string_split({_norm(c)}, ' '), lambda w: w <> '')"


def _runs(c: str) -> str:
    w = _words(c)
    return f"(SELECT list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) FROM (SELECT {w} AS w))"


@query(f"SELECT doc_id, {_norm('text')} AS normal FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalized(F.col("text")).alias("normal"))


@query(f"SELECT doc_id, {_norm('text')} AS normal FROM documents")
def normalize_unicode(spark, d):
    """The general form; equal to the fast one on texts in NFKC."""
    return table(spark, d, "documents").select("doc_id", T.normalized_unicode(F.col("text")).alias("normal"))


@query(f"SELECT doc_id, CAST(len({_words('text')}) AS INTEGER) AS n_words FROM documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.words(T.normalized(F.col("text")))).alias("n_words"))


@query(f"SELECT doc_id, CAST(len({_runs('text')}) AS INTEGER) AS n_shingles FROM documents")
def shingle_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.shingles(T.words(T.normalized(F.col("text"))))).alias("n_shingles"))


def _source(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.lit(0).cast("long").alias("doc_id"), F.col("item_id").alias("page"), "text")


def _derived(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.lit(0).cast("long").alias("doc_id"), "text")


_COVER = f"""own AS (SELECT item_id, unnest({_runs('text')}) AS s FROM benchmark),
there AS (SELECT DISTINCT s FROM (SELECT unnest({_runs('text')}) AS s FROM documents)),
cover AS (SELECT item_id, count(*) AS shingles, count(there.s) AS hits FROM own LEFT JOIN there ON own.s = there.s GROUP BY item_id),
bypage AS (SELECT item_id, coalesce(shingles, 0) AS shingles, coalesce(hits, 0) AS hits, CASE WHEN coalesce(shingles, 0) = 0 THEN 1.0 ELSE hits / shingles END AS coverage FROM benchmark LEFT JOIN cover USING (item_id))"""


@query(f"WITH {_COVER} SELECT item_id, CAST(shingles AS BIGINT) AS shingles, CAST(hits AS BIGINT) AS hits, CAST(coverage AS DOUBLE) AS coverage FROM bypage")
def item_coverage(spark, d):
    return fidelity.page_coverage(_source(spark, d), _derived(spark, d)).select(F.col("page").alias("item_id"), "shingles", "hits", "coverage")


@query(f"WITH {_COVER} SELECT CAST(count(*) AS BIGINT) AS pages, round(coalesce(avg(CASE WHEN shingles > 0 THEN coverage END), 0.0), 9) AS text_coverage FROM bypage")
def text_coverage(spark, d):
    got = fidelity.text_coverage(fidelity.page_coverage(_source(spark, d), _derived(spark, d)))
    return got.select("pages", F.round("text_coverage", 9).alias("text_coverage"))


@query(f"WITH {_COVER}, ranked AS (SELECT *, row_number() OVER (ORDER BY item_id) AS pos FROM bypage), poor AS (SELECT *, pos - row_number() OVER (ORDER BY item_id) AS island FROM ranked WHERE coverage < 0.5 AND shingles > 0), spans AS (SELECT min(pos) AS first, max(pos) AS last FROM poor GROUP BY island) SELECT CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS span, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last FROM spans")
def missing_spans(spark, d):
    return fidelity.missing_spans(fidelity.page_coverage(_source(spark, d), _derived(spark, d))).select("span", "first", "last")


@query(f"WITH src AS (SELECT DISTINCT s FROM (SELECT unnest({_runs('t')}) AS s FROM (SELECT string_agg({_norm('text || chr(32) || item_id || chr(45) || chr(10)')}, ' ' ORDER BY item_id) AS t FROM benchmark))), own AS (SELECT doc_id, unnest({_runs('text')}) AS s FROM documents) SELECT doc_id, CAST(count(*) AS BIGINT) AS derived_shingles, CAST(count(*) - count(src.s) AS BIGINT) AS extra, (count(*) - count(src.s)) / count(*) AS extra_ratio FROM own LEFT JOIN src ON own.s = src.s GROUP BY doc_id")
def extra_ratio(spark, d):
    """Shingles of each document that the benchmark, as one book, lacks. Every page ends with a hyphen and a line break, which join nothing across pages."""
    pages = table(spark, d, "benchmark").select(F.col("item_id").alias("page"), F.concat("text", F.lit(" "), F.col("item_id").cast("string"), F.lit("-\n")).alias("text"))
    return fidelity.extra_against(pages, table(spark, d, "documents").select("doc_id", "text"))


_TITLE, _BODY = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)", "regexp_extract(html, '(?s)<body[^>]*>(.*)</body>', 1)"


@query(f"WITH p AS (SELECT page_id, {_TITLE} AS title, {_norm(_BODY)} AS body FROM pages), t AS (SELECT page_id, 0 AS ord, title FROM p UNION ALL SELECT page_id - 1, 1, title FROM p UNION ALL SELECT page_id, 2, 'Abc' FROM p), j AS (SELECT t.page_id, t.ord, t.title, contains(p.body, {_norm('t.title')}) AS there FROM t JOIN p ON t.page_id = p.page_id WHERE length({_norm('t.title')}) >= 4) SELECT page_id, CAST(count(*) AS BIGINT) AS titles, CAST(count(*) FILTER (there) AS BIGINT) AS found, count(*) FILTER (there) / count(*) AS toc_coverage, coalesce(string_agg(title, '|' ORDER BY ord) FILTER (NOT there), '') AS missing FROM j GROUP BY page_id")
def title_coverage(spark, d):
    """Each page's contents name its own title, the next page's, and one that is too short to count."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", r"(?s)<body[^>]*>(.*)</body>", 1).alias("body"))
    entries = F.array(F.struct(F.col("page_id").alias("doc_id"), F.lit(0).alias("ord"), "title"), F.struct((F.col("page_id") - 1).alias("doc_id"), F.lit(1).alias("ord"), "title"), F.struct(F.col("page_id").alias("doc_id"), F.lit(2).alias("ord"), F.lit("Abc").alias("title")))
    toc = p.select(F.explode(entries).alias("e")).select("e.*")
    derived = p.select(F.col("page_id").alias("doc_id"), F.col("body").alias("text"))
    got = fidelity.title_coverage(toc.join(derived.select("doc_id"), "doc_id", "left_semi"), derived)
    return got.select(F.col("doc_id").alias("page_id"), "titles", "found", "toc_coverage", F.array_join("missing", "|").alias("missing"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text || CASE WHEN doc_id % 3 = 0 THEN ' itÂ® isÃ–' ELSE '' END, '[ÂÃ][-¿–—‘’“”®©]')) AS INTEGER) AS mojibake FROM documents")
def suspicious_bytes(spark, d):
    """The data has no such damage, so a third of the texts get some."""
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " itÂ® isÃ–").otherwise(""))
    return table(spark, d, "documents").select("doc_id", fidelity.suspicious(text).cast("int").alias("mojibake"))


def _pick(by, *values) -> F.Column:
    """The value whose place is ``by``, from 0."""
    return F.element_at(F.array(*[v if isinstance(v, F.Column) else F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


@query("SELECT doc_id, source || ' ' || ['é', '®', 'ü', '€', 'naïve', '–', 'Â ok', 'plain'][doc_id % 8 + 1] || ' ' || lang AS repaired FROM documents")
def encoding_repair(spark, d):
    """Words whose UTF-8 was read as cp1252, one that only looks like it, and an undamaged one."""
    damaged = _pick(F.col("doc_id"), "Ã©", "Â®", "Ã¼", "â‚¬", "naÃ¯ve", "â€“", "Â ok", "plain")
    return table(spark, d, "documents").select("doc_id", T.encoding_repaired(F.concat("source", F.lit(" "), damaged, F.lit(" "), "lang")).alias("repaired"))


@query(f"SELECT doc_id, {_norm("replace(replace(text, ' e', ' fie'), ' t', ' s' || chr(39) || 't')")} AS normal FROM documents")
def normalize_ligatures(spark, d):
    """Ligatures, full-width signs, final sigma, soft hyphens and hyphens at line ends are put in; the normal form has none of them."""
    text = F.replace(F.replace("text", F.lit(" e"), F.lit(" \ufb01\u00ade")), F.lit(" t"), F.lit(" s\uff07-\n t"))
    text = F.replace(text, F.lit("\uff07-\n "), F.lit("\uff07"))
    return table(spark, d, "documents").select("doc_id", T.normalized(text).alias("normal"))


@query("SELECT doc_id, 'οδοσ ' || lower(source) || ['strasse', 'fluss', 'k', 'viii'][doc_id % 4 + 1] AS normal FROM documents")
def normalize_case(spark, d):
    """Letters that fold otherwise than they are lowered."""
    return table(spark, d, "documents").select("doc_id", T.normalized(F.concat(F.lit("ΟΔΟΣ "), "source", _pick(F.col("doc_id"), "Straße", "ﬂuſſ", "\u212a", "Ⅷ"))).alias("normal"))


def _log_markdown(spark, d) -> DataFrame:
    """Conversations as markdown documents: a heading for each turn, its text below."""
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return c.select("doc_id", F.array_join(F.transform("t", lambda x: F.concat(F.lit("# "), x["role"], F.lit(" "), x["turn"].cast("string"), F.lit("\n\n"), x["text"])), "\n\n").alias("text"))


@query("SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS idx, role || ' ' || turn AS title, trim(text, E' \\n\\t') AS body FROM conversations")
def chapter_split(spark, d):
    return shaping.chapters(_log_markdown(spark, d))


@query(r"""WITH RECURSIVE para AS (SELECT doc_id, CAST(k AS INTEGER) AS k, p FROM (SELECT doc_id, unnest(string_split(text, E'\n')) AS p, generate_subscripts(string_split(text, E'\n'), 1) AS k FROM documents)),
walk AS (SELECT doc_id, k, p, 1 AS part, length(p) + 2 AS n FROM para WHERE k = 1 UNION ALL SELECT b.doc_id, b.k, b.p, CASE WHEN a.n + length(b.p) > 500 THEN a.part + 1 ELSE a.part END, CASE WHEN a.n + length(b.p) > 500 THEN length(b.p) + 2 ELSE a.n + length(b.p) + 2 END FROM walk a JOIN para b ON b.doc_id = a.doc_id AND b.k = a.k + 1)
SELECT doc_id, CAST(part AS INTEGER) AS part_no, string_agg(p, E'\n\n' ORDER BY k) AS body FROM walk GROUP BY doc_id, part""")
def chapter_pack(spark, d):
    parts = shaping.packed(F.split("text", "\n"), 500)
    return table(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("pos", "body")).select("doc_id", (F.col("pos") + 1).alias("part_no"), "body")


@query(r"SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN E'```\n' || trim(text, E' \n\t') || E'\n``` and more' ELSE trim(text, E' \n\t') END AS clean FROM documents")
def recognition_clean(spark, d):
    """Texts with a model's tokens (another one for each document, one of them split by the next), page tags and a fence around the whole, which cleaning takes away; a fence around a part stays."""
    token = _pick(F.col("doc_id"), *shaping.MODEL_TOKENS)
    dirty = F.concat(token, F.lit("<|eot_<|im_end|>id|><PAGE n=1>"), F.col("text"), F.lit("</PAGE>"), token)
    fenced = _pick(F.col("doc_id"), F.concat(F.lit("```markdown\n"), dirty, F.lit("\n```  ")), F.concat(F.lit(" \n```\n"), dirty, F.lit("\n```\n")), dirty, F.concat(F.lit("```\n"), T.strip(F.col("text")), F.lit("\n``` and more")))
    return table(spark, d, "documents").select("doc_id", shaping.recognised_clean(fenced).alias("clean"))


@query("SELECT item_id // 8 AS batch, CAST(count(*) AS BIGINT) AS pages FROM (SELECT CAST(item_id AS INTEGER) AS item_id FROM benchmark) GROUP BY 1")
def page_batches(spark, d):
    return shaping.batches(table(spark, d, "benchmark"), "item_id").groupBy("batch").agg(F.count("*").alias("pages"))


@query("SELECT item_id // 8 AS batch, string_agg(text, E'\\n\\n' ORDER BY item_id) AS text FROM (SELECT CAST(item_id AS INTEGER) AS item_id, trim(text) AS text FROM benchmark) GROUP BY 1")
def batch_texts(spark, d):
    return shaping.joined_in_order(shaping.batches(table(spark, d, "benchmark"), "item_id"), ["batch"], "item_id", "text")


@query("SELECT conv_id AS doc_id, string_agg(CASE WHEN turn % 2 = 0 THEN '# ' || role || E'\\n\\n' ELSE '' END || trim(text, E' \\n\\t'), E'\\n\\n' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def text_layer(spark, d):
    """Turns are pages; every other page has a heading in the table of contents."""
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_index"), "text", "role")
    toc = pages.filter("page_index % 2 = 0").select("doc_id", F.lit(0).alias("ord"), F.lit(1).alias("level"), F.col("role").alias("title"), (F.col("page_index") + 1).alias("page_number"))
    return shaping.text_layer(pages.drop("role"), toc)


_SPANS = r"""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN SPAN || 'σ<sub>' || source || '</sub></span> = ' || lang WHEN 1 THEN SPAN || 'x<sup>' || source || '</sup> &lt; ' || lang || '</span>'
WHEN 2 THEN 'a ' || SPAN || 'α<sub>' || lang || '</sub></span> ≤ b' WHEN 3 THEN E'```\nrecord_{' || source || E'}\n```\n' || SPAN || 'y<sub>' || lang || '</sub></span>'
WHEN 4 THEN SPAN || source || ' → ∞ &amp; \lex</span> costs \$5' WHEN 5 THEN SPAN || 'β<sub>' || lang || '</sub>^{2}</span>'
WHEN 6 THEN SPAN || '∑_{' || lang || '} μ<sub>' || source || '</sub></span>' ELSE source || '_{' || lang || ' x' END AS html FROM documents"""


@query(_SPANS.replace("SPAN", "'<span class=\"math\" role=\"math\">'"))
def math_render(spark, d):
    """Formulas in every kind of delimiter, without one, in code, with commands, entities and scripts that have no base."""
    line = _pick(
        F.col("doc_id"),
        F.concat(F.lit("σ_{"), "source", F.lit("} = "), "lang"),
        F.concat(F.lit("$x^{"), "source", F.lit("} < "), "lang", F.lit("$")),
        F.concat(F.lit("a α"), "lang", F.lit(" ≤ b")),
        F.concat(F.lit("```\nrecord_{"), "source", F.lit("}\n```\ny_{"), "lang", F.lit("}")),
        F.concat(F.lit("\\("), "source", F.lit(" \\to \\infty & \\lex\\) costs \\$5")),
        F.concat(F.lit("$$\\beta_{"), "lang", F.lit("}^{2}$$")),
        F.concat(F.lit("\\[\\sum_{"), "lang", F.lit("} \\mu_{"), "source", F.lit("}\\]")),
        F.concat("source", F.lit("_{"), "lang", F.lit(" x")),
    )
    return table(spark, d, "documents").select("doc_id", T.math_rendered(line).alias("html"))


@query("SELECT doc_id, ['α ≤ β → ', 'Σ × ∞ ', '\\alphabet ∈ ∉ ', 'x ≥ y ≠ z ≈ '][doc_id % 4 + 1] || lang || ' \\lex' AS text FROM documents")
def math_commands(spark, d):
    line = _pick(F.col("doc_id"), "\\alpha \\le \\beta \\to ", "\\Sigma \\times \\infty ", "\\alphabet \\in \\notin ", "x \\ge y \\neq z \\approx ")
    return table(spark, d, "documents").select("doc_id", T.math_symbols(F.concat(line, "lang", F.lit(" \\lex"))).alias("text"))


def _tags(spark, d) -> DataFrame:
    tags = F.transform(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower)
    return table(spark, d, "pages").select("page_id", F.explode(tags).alias("tag"))


_TAGS = "SELECT page_id, unnest(list_transform(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda t: lower(t))) AS tag FROM pages"
_ALLOWED = ", ".join(f"'{t}'" for t in sorted(markup.ALLOWED_TAGS))


@query(f"SELECT tag, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT page_id) AS BIGINT) AS pages FROM ({_TAGS}) GROUP BY tag")
def tag_census(spark, d):
    by_page = _tags(spark, d).groupBy("tag", "page_id").agg(F.count("*").alias("n"))
    return by_page.groupBy("tag").agg(F.sum("n").alias("n"), F.count("*").alias("pages"))


@query(f"SELECT page_id, tag, CAST(count(*) AS BIGINT) AS n FROM ({_TAGS}) WHERE tag NOT IN ({_ALLOWED}) GROUP BY ALL")
def unknown_tags(spark, d):
    return _tags(spark, d).filter(~F.col("tag").isin(sorted(markup.ALLOWED_TAGS))).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("SELECT attr, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(html, ' ([a-z-]+)=\"', 1)) AS attr FROM pages) WHERE attr NOT IN ('href', 'lang') GROUP BY attr")
def attribute_violations(spark, d):
    """Attributes outside a short whitelist, by anti join."""
    allowed = spark.createDataFrame([("href",), ("lang",)], "attr string")
    found = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(' ([a-z-]+)="'), F.lit(1))).alias("attr"))
    return found.groupBy("attr").agg(F.count("*").alias("n")).join(F.broadcast(allowed), "attr", "left_anti")


@query()
def fragments_cleaned(spark, d):
    return table(spark, d, "pages").select("page_id", markup.fragment_cleaned("html").alias("c")).select("page_id", "c.html", "c.changes")


@query("""SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN '<p>' || source || '</p>' WHEN 1 THEN source || ' x' WHEN 2 THEN source WHEN 3 THEN '<p class="k">' || source || '</p>' WHEN 4 THEN '<p>' || source || '</p>'
WHEN 5 THEN '<p>' || lang || '<b>' || source || '</b></p>' WHEN 6 THEN '<ul><li>' || source || '</li></ul>' WHEN 7 THEN '<p>a &lt; b &amp; ' || lang || '<br/></p>' WHEN 8 THEN 'x' || source ELSE '<p data-k="1" aria-label="l" epub:type="t">' || lang || '</p>' END AS html,
CAST([0, 1, 1, 2, 1, 1, 1, 0, 1, 1][doc_id % 10 + 1] AS INTEGER) AS changes FROM documents""")
def fragment_rules(spark, d):
    """One fragment for each rule of the filter: unknown tags, tags outside their parent, attributes, images without a file, comments, open tags, entities."""
    html = _pick(
        F.col("doc_id"),
        F.concat(F.lit("<p>"), "source", F.lit("</p>")),
        F.concat(F.lit("<page>"), "source", F.lit("</page> x")),
        F.concat(F.lit("<li>"), "source", F.lit("</li>")),
        F.concat(F.lit('<p onclick="x" class="k" color=red>'), "source", F.lit("</p>")),
        F.concat(F.lit("<p>"), "source", F.lit('<img src="gone.jpg"></p>')),
        F.concat(F.lit("<p>"), "lang", F.lit("<!-- c --><b>"), "source"),
        F.concat(F.lit("<ul><li>"), "source", F.lit('</li></ul><img alt="none">')),
        F.concat(F.lit("<p>a &lt; b & "), "lang", F.lit("<br></p>")),
        F.concat(F.lit("<td>x</td>"), "source"),
        F.concat(F.lit('<p data-k="1" aria-label="l" epub:type="t" hidden2="">'), "lang", F.lit("</p>")),
    )
    return table(spark, d, "documents").select("doc_id", markup.fragment_cleaned(html).alias("c")).select("doc_id", "c.html", "c.changes")


@query()
def markdown_html(spark, d):
    return _log_markdown(spark, d).select("doc_id", markup.markdown_rendered("text").alias("html"))


@query(r"""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '<h2>' || source || '</h2>' WHEN 1 THEN '<p>a <strong>' || source || '</strong> <em>' || lang || '</em></p>' WHEN 2 THEN '<ul><li>' || source || '<ul><li>' || lang || '</li></ul></li><li>z</li></ul>'
WHEN 3 THEN '<pre><code>' || source || E'_x *y*
</code></pre>' WHEN 4 THEN '<p><a href="http://h/' || lang || '">' || source || '</a></p>' WHEN 5 THEN '<table><thead><tr><th>a</th><th>' || source || '</th></tr></thead><tbody><tr><td>1</td><td>' || lang || '</td></tr></tbody></table>'
WHEN 6 THEN '<ol><li>' || source || '</li><li>' || lang || '</li></ol>' ELSE '<blockquote><p>' || source || '</p></blockquote>' || E'
<hr/>' END AS html FROM documents""")
def markdown_blocks(spark, d):
    """One text for each kind of block."""
    text = _pick(
        F.col("doc_id"),
        F.concat(F.lit("## "), "source"),
        F.concat(F.lit("a __"), "source", F.lit("__ _"), "lang", F.lit("_")),
        F.concat(F.lit("- "), "source", F.lit("\n    - "), "lang", F.lit("\n- z")),
        F.concat(F.lit("```\n"), "source", F.lit("_x *y*\n```")),
        F.concat(F.lit("["), "source", F.lit("][r]\n\n[r]: http://h/"), "lang"),
        F.concat(F.lit("a | "), "source", F.lit("\n--|--\n1 | "), "lang"),
        F.concat(F.lit("1. "), "source", F.lit("\n2. "), "lang"),
        F.concat(F.lit("> "), "source", F.lit("\n\n---")),
    )
    return table(spark, d, "documents").select("doc_id", markup.markdown_rendered(text).alias("html"))


def _hrefs(spark, d) -> DataFrame:
    """Every link of a page in one of seven spellings: as it is, with detours, with escapes, with a query, absolute, without a scheme, and as a bare fragment."""
    refs = table(spark, d, "pages").select(F.lit("site").alias("epub"), F.concat(F.lit("site/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("doc_path"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ord", "href"))
    name = F.concat(F.lit("n"), F.length("href").cast("string"))
    spelt = _pick(F.col("ord"), F.concat(name, F.lit(".x")), F.concat(F.lit("../x/./y/../"), name), F.concat(F.lit("%66%6Fo%20a+b/"), name, F.lit("%zz")), F.concat(F.lit("./"), name, F.lit("?q=%20#f")), F.concat(F.lit("HTTPS://h/"), name), F.concat(F.lit("//h/"), name), F.concat(F.lit("#"), name))
    return refs.select("epub", "doc_path", "ord", F.lit("a").alias("tag"), F.lit("href").alias("attr"), spelt.alias("value"))


_HREFS = "SELECT doc_path, CAST(ord - 1 AS INTEGER) AS ord, 'n' || length(href) AS name FROM (SELECT 'site/p' || page_id || '.html' AS doc_path, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) AS ord FROM pages)"
_TARGET = "CASE ord % 7 WHEN 0 THEN 'site/' || name || '.x' WHEN 1 THEN 'x/' || name WHEN 2 THEN 'site/foo a+b/' || name || '%zz' WHEN 3 THEN 'site/' || name END"


@query(f"SELECT doc_path, ord, {_TARGET} AS target, ord % 7 = 4 OR ord % 7 = 5 AS external, ord % 7 = 4 AS remote FROM ({_HREFS})")
def hrefs_resolved(spark, d):
    return package.resolved_refs(_hrefs(spark, d)).select("doc_path", "ord", "target", "external", "remote")


@query(f"SELECT doc_path, ord, target FROM (SELECT doc_path, ord, {_TARGET} AS target FROM ({_HREFS})) WHERE target IS NOT NULL AND length(target) % 2 = 1")
def broken_refs(spark, d):
    """The archive holds the targets of even length, so the others are broken."""
    refs = _hrefs(spark, d)
    there = package.resolved_refs(refs).filter(F.length("target") % 2 == 0).select("epub", F.col("target").alias("name")).distinct()
    return package.broken_refs(refs, there).select("doc_path", "ord", "target")


@query("SELECT page_id, href, CAST(min(k) AS INTEGER) AS first FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) - 1 AS k FROM pages) GROUP BY page_id, href")
def first_ref(spark, d):
    hits = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("k", "href"))
    return hits.groupBy("page_id", "href").agg(F.min("k").alias("first"))


@query("SELECT doc_id, CAST(doc_id % 5 AS INTEGER) AS page_index, CAST(doc_id % 7 AS INTEGER) AS image_index, CASE WHEN doc_id % 3 = 0 THEN 'IMAGES' ELSE 'images' END || '/page_' || doc_id % 5 || '_' || doc_id % 7 || ['.JPG', '.png', '.gif', '.jpeg', '.webp'][doc_id % 5 + 1] AS ref FROM documents UNION ALL SELECT doc_id, 9, 0, 'images/page_09_00.jpg' FROM documents WHERE doc_id % 2 = 0")
def figure_refs(spark, d):
    """Two spellings of one figure, of which the first is kept, a second figure in half of the texts, and names that are no figures."""
    k = F.concat(F.lit("/page_"), (F.col("doc_id") % 5).cast("string"), F.lit("_"), (F.col("doc_id") % 7).cast("string"))
    first = F.concat(F.when(F.col("doc_id") % 3 == 0, "IMAGES").otherwise("images"), k, _pick(F.col("doc_id"), ".JPG", ".png", ".gif", ".jpeg", ".webp"))
    text = F.concat(F.lit("a images/page_x_1.jpg images/page_1_2.bmp "), first, F.lit(" b images"), k, F.lit(".png"), F.when(F.col("doc_id") % 2 == 0, " images/page_09_00.jpg images/page_9_0.png").otherwise(""))
    return shaping.figure_refs(table(spark, d, "documents").select("doc_id", text.alias("text"))).select("doc_id", "page_index", "image_index", "ref")


@query("SELECT l_orderkey AS doc_id, CAST(min(l_linenumber) AS INTEGER) AS image_index, l_partkey AS xref FROM lineitem WHERE l_quantity >= 10 GROUP BY l_orderkey, l_partkey HAVING min_by(l_discount, l_linenumber) < 0.08")
def figures_kept(spark, d):
    """Order lines as images: part as xref, quantity as size, discount as share of the page. Of lines that repeat a number the first in the table counts."""
    x = table(spark, d, "lineitem").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.col("l_linenumber").alias("image_index"), F.col("l_partkey").alias("xref"), (F.col("l_quantity") * 8).alias("width"), (F.col("l_quantity") * 8).alias("height"), (F.col("l_discount") * 10).alias("area_fraction"))
    return shaping.figures_kept(x, ("file", "row")).select("doc_id", F.col("image_index").cast("int").alias("image_index"), "xref")


def _parts_manifest(spark, d):
    m = table(spark, d, "part").select(F.col("p_brand").alias("epub"), F.col("p_partkey").cast("int").alias("ord"), F.col("p_name").alias("id"), F.lit("").alias("href"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.lit("").alias("media_type"), F.array().cast("array<string>").alias("properties"), F.col("p_size"))
    members = m.select("epub", F.concat(F.lit("f"), (F.col("ord") * 2).cast("string")).alias("name"))
    return m, members


@query("WITH m AS (SELECT p_brand AS epub, 'f' || p_partkey AS path, 'f' || p_partkey * 2 AS name FROM part) SELECT 'missing' AS side, epub, path FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.epub = a.epub AND b.name = a.path) UNION ALL SELECT 'undeclared', epub, name FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.epub = a.epub AND b.path = a.name)")
def manifest_vs_archive(spark, d):
    """Parts as manifest entries of their brand; the archive holds files of doubled numbers."""
    m, members = _parts_manifest(spark, d)
    opf = m.select("epub", F.lit(None).cast("string").alias("opf_path")).distinct()
    lost = package.manifest_missing(m, members).select(F.lit("missing").alias("side"), "epub", "path")
    return lost.unionAll(package.undeclared(m, members, opf).select(F.lit("undeclared"), "epub", "name"))


@query("SELECT o_custkey AS epub, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS pos, 'f' || o_custkey AS path FROM orders WHERE o_custkey % 3 <> 0")
def spine_order(spark, d):
    """Orders as spine items of a customer; a third of the customers has no manifest entry."""
    spine = table(spark, d, "orders").select(F.col("o_custkey").alias("epub"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("pos"), F.col("o_custkey").cast("string").alias("idref"))
    entries = table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("epub"), F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("path"))
    return package.spine_paths(spine, entries).select("epub", "pos", "path")


def _findings(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("epub"), "doc_id", "n_chars")
    short = package.finding(docs.filter("n_chars < 100"), "warning", "text/short", F.col("n_chars").cast("string"), F.col("doc_id"), order=1)
    toxic = table(spark, d, "labels").join(docs, "doc_id").filter("toxic = 1")
    return short.unionByName(package.finding(toxic, "error", "text/toxic", F.lit("toxic"), F.col("doc_id"), layer="labels", order=2))


@query("WITH f AS (SELECT source AS epub, 'warning' AS level FROM documents WHERE n_chars < 100 UNION ALL SELECT source, 'error' FROM labels JOIN documents USING (doc_id) WHERE toxic = 1), c AS (SELECT epub, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings FROM f GROUP BY epub) SELECT e.epub, CAST(coalesce(errors, 0) AS BIGINT) AS errors, CAST(coalesce(warnings, 0) AS BIGINT) AS warnings, CAST(0 AS BIGINT) AS infos, CASE WHEN errors > 0 THEN 'fail' WHEN warnings > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM (SELECT DISTINCT source AS epub FROM documents) e LEFT JOIN c ON c.epub = e.epub")
def findings_verdict(spark, d):
    epubs = table(spark, d, "documents").select(F.col("source").alias("epub")).distinct()
    return report.verdicts(epubs, _findings(spark, d))


@query("WITH f AS (SELECT source AS epub, 'format' AS layer, 'warning' AS level FROM documents WHERE n_chars < 100 UNION ALL SELECT source, 'labels', 'error' FROM labels JOIN documents USING (doc_id) WHERE toxic = 1) SELECT epub, layer, count(*) FILTER (level = 'error') = 0 AS passed FROM f GROUP BY epub, layer")
def layers_passed(spark, d):
    return report.layers(_findings(spark, d))


@query("WITH f AS (SELECT source AS epub, 'format' AS layer, 1 AS ord, 'warning' AS level, 'text/short' AS code, CAST(n_chars AS VARCHAR) AS message, CAST(doc_id AS VARCHAR) AS location FROM documents WHERE n_chars < 100 UNION ALL SELECT source, 'labels', 2, 'error', 'text/toxic', 'toxic', CAST(doc_id AS VARCHAR) FROM labels JOIN documents USING (doc_id) WHERE toxic = 1), c AS (SELECT epub, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings, list({'layer': layer, 'ord': ord, 'level': level, 'code': code, 'message': message, 'location': location} ORDER BY layer, ord, level, code, message, location) AS found FROM f GROUP BY epub) SELECT e.epub, CAST(to_json({'verdict': CASE WHEN errors > 0 THEN 'fail' WHEN warnings > 0 THEN 'warn' ELSE 'pass' END, 'counts': {'errors': coalesce(errors, 0), 'warnings': coalesce(warnings, 0), 'infos': 0}, 'findings': coalesce(found, [])}) AS VARCHAR) AS report FROM (SELECT DISTINCT source AS epub FROM documents) e LEFT JOIN c ON c.epub = e.epub")
def report_json(spark, d):
    epubs = table(spark, d, "documents").select(F.col("source").alias("epub")).distinct()
    found = _findings(spark, d)
    return report.as_json(report.verdicts(epubs, found), found)


@query("SELECT epub, code, location FROM (SELECT *, row_number() OVER (PARTITION BY epub ORDER BY layer, location) AS n FROM (SELECT source AS epub, 'format' AS layer, 'text/short' AS code, CAST(doc_id AS VARCHAR) AS location FROM documents WHERE n_chars < 100 UNION ALL SELECT source, 'labels', 'text/toxic', CAST(doc_id AS VARCHAR) FROM labels JOIN documents USING (doc_id) WHERE toxic = 1)) WHERE n <= 60")
def console_report(spark, d):
    return report.console(_findings(spark, d)).select("epub", "code", "location")


@query("SELECT 'item ' || item_id || '.epub' AS filename, CAST(100 + strlen(text) AS BIGINT) AS size FROM benchmark")
def library_listing(spark, d):
    """Files of known sizes are written to a folder, beside others that are no packages, and listed."""
    folder = core.work_folder(spark, "library")
    rows = table(spark, d, "benchmark").select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name"), F.rpad(F.encode("text", "UTF-8"), F.lit(100) + F.octet_length("text"), F.lit(" ").cast("binary")).alias("content"))
    rows = rows.select(F.explode(F.array(*[F.struct(F.concat("name", F.lit(end)).alias("filename"), "content") for end in (".epub", ".txt")])).alias("f")).select("f.*")
    epub.write_files(rows, folder)
    return report.library(spark, folder).select("filename", F.col("size").cast("long").alias("size"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def job_status(spark, d):
    return report.latest_status(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '[^\\p{L}\\p{N}\\-_ ]', '_', 'g')) AS name FROM pages")
def safe_name(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_name(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("name"))


@query("""WITH x AS (SELECT doc_id, n_chars, doc_id % 7 AS k FROM documents) SELECT doc_id, code, CAST(n AS BIGINT) AS n FROM (
SELECT doc_id, CASE k WHEN 0 THEN 'render/load-failed' WHEN 1 THEN 'render/broken-images' WHEN 2 THEN 'render/resource-failed' WHEN 3 THEN 'render/page-error' WHEN 4 THEN 'render/horizontal-overflow' END AS code, CASE k WHEN 2 THEN 5 WHEN 3 THEN 2 ELSE 1 END AS n FROM x WHERE k < 5
UNION ALL SELECT doc_id, 'render/blank-document', 1 FROM x WHERE n_chars < 20 AND k NOT IN (0, 1, 6) UNION ALL SELECT doc_id, 'render/book-blank', 1 FROM x WHERE n_chars < 200)""")
def render_findings(spark, d):
    """Each document as a book of one rendered page; the report shows another fault for each, and short texts are blank unless they have an image or are a navigation."""
    k = F.col("doc_id") % 7
    none = F.array().cast("array<string>")
    many = lambda n, when: F.when(k == when, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string"))).otherwise(none)
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("epub"), F.lit(0).alias("pos"), F.lit("p.xhtml").alias("document"), (k == 6).alias("is_nav"), F.when(k == 0, "timeout").alias("load_error"), many(2, 3).alias("page_errors"), many(8, 2).alias("failed_requests"), many(7, 1).alias("broken_images"), F.col("n_chars").cast("int").alias("visible_text_chars"), F.when(k == 1, 7).otherwise(0).alias("image_count"), (k == 4).alias("horizontal_overflow"))
    return package.render_findings(docs).groupBy(F.col("epub").cast("long").alias("doc_id"), "code").agg(F.count("*").alias("n"))


@query("SELECT source AS epub, CAST(count(*) AS BIGINT) AS documents, CAST(sum(n_chars) AS BIGINT) AS visible_text_chars, CAST(count(*) AS BIGINT) AS broken_images FROM documents GROUP BY source")
def render_totals(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("epub"), F.col("n_chars").alias("visible_text_chars"), F.array(F.lit("x")).alias("broken_images"))
    return package.render_totals(docs)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS epub, CASE o_orderpriority WHEN '1-URGENT' THEN 'error' WHEN '2-HIGH' THEN 'error' WHEN '3-MEDIUM' THEN 'warning' ELSE 'info' END AS level, 'epubcheck/' || o_orderstatus AS code, 'a:1, a:2, a:3 (+1 more)' AS location FROM orders")
def tool_findings(spark, d):
    """Orders as messages of an external validator; each has four places, of which three are told."""
    names = F.create_map(*[F.lit(x) for kv in {"1-URGENT": "FATAL", "2-HIGH": "ERROR", "3-MEDIUM": "WARNING"}.items() for x in kv])
    places = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.struct(F.lit("a").alias("path"), k.alias("line")))
    m = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("epub"), F.lit(0).alias("ord"), F.col("o_orderstatus").alias("id"), F.coalesce(F.element_at(names, F.col("o_orderpriority")), F.lit("INFO")).alias("severity"), F.lit("").alias("message"), places.alias("locations"))
    return package.tool_findings(m).select("epub", "level", "code", "location")


@query("SELECT CAST(o_custkey AS VARCHAR) AS output_file, min(o_orderkey) AS job FROM orders GROUP BY o_custkey")
def job_sources(spark, d):
    from ..sources import recognition

    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").cast("string").alias("output_file"), F.col("o_orderkey").alias("pdf_path"))
    return recognition.source_of(jobs, jobs.select("output_file").distinct()).select("output_file", F.col("pdf_path").alias("job"))


@query("SELECT doc_id, 'chapter_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS VARCHAR), 3, '0') || '.xhtml' AS name FROM (SELECT conv_id AS doc_id, turn AS idx FROM conversations)")
def chapter_names(spark, d):
    parts = shaping.sized(shaping.chapters(_log_markdown(spark, d)))
    return shaping.chapter_documents(parts).select("doc_id", "name")


@query("SELECT window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM (SELECT date_trunc('hour', ts) AS window_start, event_type, value FROM events) GROUP BY ALL")
def hourly_counts(spark, d):
    """The batch form of the windowed stream."""
    from ..streaming import folder

    return folder.hourly_counts(table(spark, d, "events")).select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


# ---- whole jobs on packages that are built from the benchmark's items, another fault in each
_BROKEN = (
    (), ("zip/unreadable",), ("zip/corrupt",), ("ocf/missing-mimetype",), ("ocf/mimetype-not-first",), ("ocf/mimetype-compressed",), ("ocf/mimetype-content",), ("ocf/missing-container",), ("ocf/bad-container",), ("ocf/no-rootfile",), ("ocf/rootfile-missing",),
    ("opf/not-xml",), ("opf/missing-metadata",), ("opf/manifest-file-missing", "content/broken-reference"), ("opf/undeclared-resource",), ("opf/empty-spine",), ("opf/no-navigation",), ("content/not-xml",), ("content/wrong-namespace",), ("content/remote-resource",), ("content/broken-reference",), ("image/not-decodable",), ("opf/manifest-file-missing",),
)


def _faulty(k: int, text: str) -> bytes:
    """A package with the fault number k of _BROKEN."""
    from html import escape

    page = f'<?xml version="1.0"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>T</title><link rel="stylesheet" type="text/css" href="style/main.css"/></head><body><p>{escape(text)}</p></body></html>'
    data = epub.built("Title", "Author", "en", "urn:x", [("chapter_001.xhtml", "One", page)], {})
    if k == 1:
        return text.encode()
    rows = [[r[2], r[4], 0 if r[2] == "mimetype" else 8] for r in epub.members_of("", data)]
    chapter = next(r for r in rows if r[0].endswith("chapter_001.xhtml"))
    change = {
        4: lambda: rows.append(rows.pop(0)), 3: lambda: rows.pop(0), 5: lambda: rows[0].__setitem__(2, 8), 6: lambda: rows[0].__setitem__(1, b"text/plain"),
        7: lambda: rows.pop(1), 8: lambda: rows[1].__setitem__(1, b"<container>"), 9: lambda: rows[1].__setitem__(1, b"<container/>"), 14: lambda: rows.append(["EPUB/more.txt", b"x", 8]),
        17: lambda: chapter.__setitem__(1, chapter[1].replace(b"</p>", b"")), 18: lambda: chapter.__setitem__(1, chapter[1].replace(b"1999/xhtml", b"1998/xhtml")),
    }
    swap = {10: ("container.xml", b"content.opf", b"gone.opf"), 11: (".opf", b"</package>", b""), 12: (".opf", b"<dc:title>Title</dc:title>", b"<dc:title> </dc:title>"), 15: (".opf", b"<itemref ", b"<none "), 19: ("001.xhtml", b"</p>", b'</p><p><a href="https://h/x">y</a></p>'), 20: ("001.xhtml", b"</p>", b'</p><p><a href="../gone%20a.xhtml#f">y</a></p>')}
    if k in change:
        change[k]()
    elif k in swap:
        end, old, new = swap[k]
        for r in rows:
            if r[0].endswith(end):
                r[1] = r[1].replace(old, new)
    elif k in (13, 22):
        gone = "style/main.css" if k == 13 else "toc.ncx"
        rows[:] = [r for r in rows if not r[0].endswith(gone)]
    elif k == 16:
        for r in rows:
            if r[0].endswith(".opf"):
                r[1] = r[1].replace(b' properties="nav"', b"").replace(b' toc="ncx"', b"")
    elif k == 21:
        rows.append(["EPUB/p.png", b"no image", 0])
        for r in rows:
            if r[0].endswith(".opf"):
                r[1] = r[1].replace(b"</manifest>", b'<item id="p" href="p.png" media-type="image/png"/></manifest>')
    made = epub.zipped([tuple(r) for r in rows])
    if k == 2:
        at = made.index(b"application/epub+zip")
        made = made[:at] + b"A" + made[at + 1 :]
    return made


def _faulty_members(spark, d) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            names = [f"{k:06d}.epub" for k in batch["item_id"].to_pylist()]
            made = [_faulty(k % len(_BROKEN), t) for k, t in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(made, pa.binary())], ["filename", "content"])

    folder = core.work_folder(spark, "faulty")
    epub.write_files(table(spark, d, "benchmark").select("item_id", "text").mapInArrow(run, "filename string, content binary"), folder)
    return epub.read_members(spark, folder).withColumn("epub", F.regexp_extract("epub", r"(\d+)\.epub$", 1).cast("long").cast("string"))


_BROKEN_SQL = "[" + ", ".join("[" + ", ".join(f"'{c}'" for c in codes) + "]::VARCHAR[]" for codes in _BROKEN) + "]"


@query(f"SELECT item_id, code FROM (SELECT item_id, unnest({_BROKEN_SQL}[item_id % {len(_BROKEN)} + 1]) AS code FROM benchmark)")
def package_rules(spark, d):
    """Every rule of the format layer on a package that breaks it; sound ones have no finding."""
    _, findings, _ = library.validate(_faulty_members(spark, d))
    return findings.select(F.col("epub").cast("long").alias("item_id"), "code").distinct()


@query(f"SELECT item_id, CASE WHEN len(c) = 0 THEN 'pass' WHEN c = ['opf/undeclared-resource'] OR c = ['content/remote-resource'] THEN 'warn' ELSE 'fail' END AS verdict FROM (SELECT item_id, {_BROKEN_SQL}[item_id % {len(_BROKEN)} + 1] AS c FROM benchmark)")
def package_verdicts(spark, d):
    verdicts, _, _ = library.validate(_faulty_members(spark, d))
    return verdicts.select(F.col("epub").cast("long").alias("item_id"), "verdict")


@query("SELECT item_id, CASE item_id % 23 WHEN 1 THEN 'render/unpack-failed' WHEN 7 THEN 'render/no-container' WHEN 8 THEN 'render/unpack-failed' WHEN 9 THEN 'render/no-container' WHEN 11 THEN 'render/unpack-failed' END AS code FROM benchmark WHERE item_id % 23 IN (1, 7, 8, 9, 11)")
def render_rules(spark, d):
    """Books that a renderer cannot open; the renderer here sees enough text in all others."""
    seen = lambda rows: rows.select("epub", "pos", "document", "is_nav", F.lit(None).cast("string").alias("load_error"), *[F.array().cast("array<string>").alias(c) for c in ("page_errors", "failed_requests", "broken_images")], F.lit(500).alias("visible_text_chars"), F.lit(0).alias("image_count"), F.lit(False).alias("horizontal_overflow"))
    _, findings, _ = library.validate(_faulty_members(spark, d), renderer=seen)
    return findings.filter("layer = 'render'").select(F.col("epub").cast("long").alias("item_id"), "code")


_FIDELITY = ((), ("fidelity/low-text-coverage", "fidelity/missing-span", "fidelity/toc-entries-missing"), ("fidelity/reduced-text-coverage", "fidelity/missing-span"), ("fidelity/extra-content",), ("fidelity/toc-entries-missing",), ("fidelity/images-dropped",), ("fidelity/mojibake",), ("fidelity/no-chapter-structure",), ("fidelity/comparison-failed",))
_FIDELITY_SQL = "[" + ", ".join("[" + ", ".join(f"'{c}'" for c in codes) + "]::VARCHAR[]" for codes in _FIDELITY) + "]"


@query(f"SELECT item_id, code FROM (SELECT item_id, unnest({_FIDELITY_SQL}[item_id % {len(_FIDELITY)} + 1]) AS code FROM benchmark)")
def fidelity_rules(spark, d):
    """Books made from five pages of each item, with another loss in each, against their source."""
    k = F.col("item_id") % len(_FIDELITY)
    words = F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: w != "")
    page = lambda n: F.array_join(F.transform(words, lambda w: F.concat(w, F.lit("abcde"[n]))), " ")
    items = core.stored(table(spark, d, "benchmark").select("item_id", F.col("item_id").cast("string").alias("epub"), k.alias("k"), F.array(*[page(n) for n in range(5)]).alias("p")), "items")
    blank = F.transform(F.sequence(F.lit(1), F.lit(45)), lambda _: F.lit(""))
    pages = items.select("epub", F.posexplode(F.when(F.col("k") == 7, F.concat("p", blank)).otherwise(F.col("p"))).alias("page", "text"))
    toc = items.select("epub", F.lit(0).alias("ord"), F.when(F.col("k") == 4, "no such title").otherwise(F.substring(F.col("p")[0], 1, 12)).alias("title"))
    images = items.filter("k = 5").select("epub", F.explode(F.array(F.lit(1), F.lit(1), F.lit(2))).alias("xref"))
    text = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.array_join(F.slice("p", 1, 4), " ")).otherwise(F.array_join("p", " "))
    text = F.concat(text, F.when(F.col("k") == 3, F.concat(F.lit(" "), F.replace(F.array_join("p", " "), F.lit(" "), F.lit("z ")))).otherwise(""), F.when(F.col("k") == 6, " OÂ®").otherwise(""))
    xhtml = F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><head/><body><p>'), text, F.lit("</p></body></html>"))
    chapters = items.select(F.col("item_id").alias("doc_id"), F.lit(1).alias("number"), F.lit("chapter_001.xhtml").alias("name"), F.lit("One").alias("title"), xhtml.alias("xhtml"))
    books = epub.write_books(chapters, items.select(F.col("item_id").alias("doc_id"), F.lit("T").alias("title"), F.lit("A").alias("author"), F.lit("en").alias("language")))
    folder = core.work_folder(spark, "books")
    epub.write_files(books.select(F.concat(F.col("doc_id").cast("string"), F.lit(".epub")).alias("filename"), F.when(F.col("doc_id") % len(_FIDELITY) == 8, F.lit(b"no archive")).otherwise(F.col("content")).alias("content")), folder)
    members = epub.read_members(spark, folder).withColumn("epub", F.regexp_extract("epub", r"(\d+)\.epub$", 1))
    _, findings, _ = library.validate(members, {"pages": pages, "toc": toc, "images": images})
    return findings.filter("layer = 'fidelity'").select(F.col("epub").cast("long").alias("item_id"), "code").distinct()


@query("SELECT item_id, CAST(2 AS BIGINT) AS chapters, CAST(1 AS BIGINT) AS figures, 'pass' AS verdict FROM benchmark")
def converted_books(spark, d):
    """Items as markdown of two chapters with a formula and a figure, converted to packages, which are then validated."""
    figure = F.lit(b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x01\x00\x01\x03\x01\x11\x00\x02\x11\x00\x03\x11\x00\xff\xda\x00\x02\x00\xff\xd9")
    items = table(spark, d, "benchmark")
    texts = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("title"), F.lit("A").alias("author"), F.concat(F.lit("# One\n\nσ_{x} = 1\n\n![](images/page_0_0.jpg) ![](images/page_9_9.jpg)\n\n# Two\n\n"), "text").alias("text"))
    images = items.select(F.col("item_id").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(0).alias("image_index"), figure.alias("content"))
    folder = core.work_folder(spark, "converted")
    epub.write_files(library.convert(texts, images), folder)
    members = core.stored(epub.read_members(spark, folder).withColumn("epub", F.regexp_extract("epub", r"(\d+)\.epub$", 1)), "members")
    verdicts, _, _ = library.validate(members)
    counted = members.groupBy("epub").agg(F.count_if(F.col("name").rlike("chapter_[0-9]+")).alias("chapters"), F.count_if(F.endswith("name", F.lit("page_0_0.jpg"))).alias("figures"))
    return verdicts.join(counted, "epub").select(F.col("epub").cast("long").alias("item_id"), "chapters", "figures", "verdict")


@query("SELECT item_id, CAST(CASE item_id % 4 WHEN 0 THEN item_id % 5 + 1 WHEN 1 THEN item_id % 7 + 1 END AS INTEGER) AS page_count, CASE WHEN item_id % 4 < 2 THEN 'pending' ELSE 'error' END AS status, CASE item_id % 4 WHEN 2 THEN 'not a PDF by its name' WHEN 3 THEN 'the PDF cannot be opened' END AS error, CAST(CASE WHEN item_id % 4 < 2 THEN 200 ELSE 400 END AS INTEGER) AS code, item_id % 4 < 2 AS kept FROM benchmark")
def uploads_accepted(spark, d):
    """Items as uploads: PDFs whose page tree or page objects tell their number, texts, and names that are no PDF's."""
    k, n = F.col("item_id") % 4, F.lit("%PDF-1.7\n")
    tree = F.concat(n, F.lit("1 0 obj << /Type /Pages /Kids [] /Count "), (F.col("item_id") % 5 + 1).cast("string"), F.lit(" >> endobj << /Type /Page >>"))
    objects = F.concat(n, F.repeat(F.lit("<< /Type /Page /Parent 1 0 R >> "), (F.col("item_id") % 7 + 1).cast("int")), F.lit("<< /Type /PageLabel >>"))
    content = F.when(k == 1, objects).when(k == 3, F.col("text")).otherwise(tree)
    name = F.concat(F.col("item_id").cast("string"), F.when(k == 2, ".doc").when(k == 1, ".PDF").otherwise(".pdf"))
    log = jobs.accept(table(spark, d, "benchmark").select(name.alias("filename"), F.encode(content, "UTF-8").alias("content")), core.work_folder(spark, "uploads"))
    page_count = F.when(F.col("error").isNull(), F.col("page_count"))
    return log.select(F.regexp_extract("original_name", r"^(\d+)", 1).cast("long").alias("item_id"), page_count.alias("page_count"), "status", "error", "code", F.col("pdf_path").isNotNull().alias("kept"))


@query("SELECT doc_id, CAST(CASE doc_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 409 WHEN 2 THEN 409 WHEN 3 THEN CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN 200 ELSE 503 END ELSE CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN 200 ELSE 503 END END AS INTEGER) AS code, doc_id % 4 = 0 AS safe, ['My Book_ 1.epub', source || '.epub', 'document.epub'][doc_id % 3 + 1] AS output FROM documents")
def job_guards(spark, d):
    """Documents as jobs in every state, with good and bad file names."""
    status = _pick(F.col("doc_id"), F.lit(None).cast("string"), "processing", "done", "pending", "error")
    name = _pick(F.col("doc_id"), "a b.EPUB", "../a.epub", "a.pdf", "x/y.epub")
    asked = _pick(F.col("doc_id"), "My Book: 1", "", F.lit(None).cast("string"))
    uploaded = _pick(F.col("doc_id"), "x.pdf", F.concat("source", F.lit(".pdf")), F.lit(None).cast("string"))
    return table(spark, d, "documents").select("doc_id", jobs.start_code(status, F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0).alias("code"), jobs.safe_filename(name).alias("safe"), jobs.output_name(asked, uploaded).alias("output"))


@query("SELECT doc_id, CAST(3 AS INTEGER) AS page_index, CAST(doc_id % 7 AS INTEGER) AS image_index FROM documents WHERE doc_id % 6 > 3")
def figures_in_range(spark, d):
    """Figures on page 3 of documents of 0 to 5 pages."""
    docs = table(spark, d, "documents")
    refs = shaping.figure_refs(docs.select("doc_id", F.concat(F.lit("images/page_3_"), (F.col("doc_id") % 7).cast("string"), F.lit(".jpg")).alias("text")))
    return jobs.in_range(refs, docs.select("doc_id", (F.col("doc_id") % 6).alias("page_count"))).select("doc_id", "page_index", "image_index")
