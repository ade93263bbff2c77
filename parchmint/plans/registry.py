"""All queries of the core and their SQL, by name. Every query reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions import analytics as A
from parchmint.functions import geometry as G
from parchmint.functions import pages as P
from parchmint.functions import text as T
from parchmint.operators import duplicates as D
from parchmint.operators import hierarchy as H
from parchmint.operators import levels as V
from parchmint.operators import repository as R
from parchmint.operators import search as S
from parchmint.operators.current import current_rows
from parchmint.session import spread

AS_OF = "2026-01-15 00:00:00"
QUERIES: dict = {}
SQL: dict[str, str] = {}

# Current rows and normal form, as the SQL engine writes them.
DOCS = "(SELECT * FROM (SELECT DISTINCT * FROM library_docs) QUALIFY row_number() OVER (PARTITION BY id ORDER BY revision DESC, updated_at DESC, title DESC) = 1)"
SEARCH = "(SELECT * FROM (SELECT DISTINCT * FROM search_docs) QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, title DESC NULLS LAST, content DESC NULLS LAST) = 1)"
PAGES = "(SELECT * FROM (SELECT DISTINCT * FROM ocr_results) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY created_at DESC) = 1)"


def norm(c: str) -> str:
    return f"trim(regexp_replace(replace(replace(replace(lower(strip_accents({c})),'œ','oe'),'æ','ae'),'ß','ss'),'[^\\p{{L}}\\p{{N}}]+',' ','g'))"


def toks(c: str) -> str:
    return f"list_distinct(list_filter(string_split({norm(f'coalesce({c}, {chr(39) * 2})')},' '), lambda x: x <> ''))"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark, d) -> DataFrame:
    return R.current_documents(table(spark, d, "library_docs"))


def search_rows(spark, d) -> DataFrame:
    return current_rows(table(spark, d, "search_docs"), "id", "updated_at", ["title", "content", "folder_path", "tags", "notes", "type", "created_at", "updated_at"])


def page_rows(spark, d) -> DataFrame:
    return current_rows(table(spark, d, "ocr_results"), "page_id", "created_at", ["doc_id", "page_index", "text", "confidence"])


# -- search -------------------------------------------------------------------------------------------------------------------
def _match(term: str, last: bool) -> str:
    """SQL of the best match of a term in a token list ``l``."""
    c = f"WHEN list_contains(l, '{term}') THEN 1.0 "
    if last and len(term) >= 2:
        c += f"WHEN len(list_filter(l, lambda t: starts_with(t, '{term}'))) > 0 THEN 0.7 "
    if len(term) >= 5:
        c += f"WHEN len(list_filter(l, lambda t: abs(length(t) - {len(term)}) <= 1 AND t[1] = '{term[0]}' AND levenshtein(t, '{term}') <= 1)) > 0 THEN 0.45 "
    return f"CASE {c}ELSE 0.0 END"


def _search_sql(terms: list[str], where: str = "true", phrase: str | None = None, limit: int | None = 100) -> str:
    date = "coalesce(strftime({0}, '%Y %Y-%m %Y-%m-%d %d/%m/%Y ') || ['janvier','fevrier','mars','avril','mai','juin','juillet','aout','septembre','octobre','novembre','decembre'][month({0})] || ' ' || lower(strftime({0}, '%B')), '')"
    dates = date.format("created_at") + " || ' ' || " + date.format("updated_at")
    per_field = {"title": "title", "tags": "array_to_string(tags, ' ')", "folder": "folder_path", "notes": "notes", "type": "type", "date": dates, "content": "content"}
    cols = ", ".join(f"{toks(c)} AS t_{k}" for k, c in per_field.items())
    match = {(i, k): _match(t, i == len(terms) - 1).replace("list_contains(l,", f"list_contains(t_{k},").replace("list_filter(l,", f"list_filter(t_{k},") for i, t in enumerate(terms) for k in per_field}
    scores = ", ".join(f"greatest({', '.join(f'({match[i, k]}) * {S.WEIGHTS[k]}' for k in per_field)}) AS s{i}" for i in range(len(terms)))
    found = ", ".join(f"CASE WHEN {' OR '.join(f'({match[i, k]}) > 0' for i in range(len(terms)))} THEN '{k}' END" for k in per_field) if terms else ""
    total = " + ".join(f"s{i}" for i in range(len(terms))) or "0.0"
    ok = " AND ".join(f"s{i} > 0" for i in range(len(terms))) or "true"
    extra, lists = "", found
    if phrase:
        inside = {k: f"contains({norm(f'coalesce({k}, {chr(39) * 2})')}, '{phrase}')" for k in ("title", "content", "notes")}
        extra = f" AND ({' OR '.join(inside.values())})"
        total += f" + CASE WHEN {inside['title']} THEN 8.0 ELSE 4.0 END"
        lists = ", ".join(x for x in (found, f"CASE WHEN {inside['title']} THEN 'title' ELSE 'content' END") if x)
    if not terms and not phrase:
        total = "1.0"
    boost = f"greatest(0.0, 0.5 - (epoch(TIMESTAMPTZ '{AS_OF}+00') - epoch(updated_at)) / {S.YEAR_SECONDS}.0)"
    arr = f"array_to_string(list_sort(list_distinct(list_filter([{lists}], lambda x: x IS NOT NULL))), ',')" if lists else "''"
    tail = f" ORDER BY score DESC, id LIMIT {limit}" if limit else ""
    return f"SELECT id, round({total} + {boost}, 6) AS score, {arr} AS fields FROM (SELECT *{', ' + scores if scores else ''} FROM (SELECT *, {cols} FROM {SEARCH} WHERE {where})) WHERE {ok}{extra}{tail}"


def _hits(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), F.array_join("fields", ",").alias("fields"))


@query(_search_sql(["facture", "filtres"]))
def search_ranked(spark, d):
    """Two terms, the second as a prefix too: the hundred best records."""
    return _hits(S.search(search_rows(spark, d), "facture filtres", AS_OF))


@query(_search_sql(["compteur"], limit=None))
def search_fuzzy(spark, d):
    """All records with a word at most one typo away."""
    return _hits(S.search(search_rows(spark, d), "compteur", AS_OF, limit=None))


@query(_search_sql(["garantie"], phrase="service comptable", limit=None))
def search_phrase(spark, d):
    return _hits(S.search(search_rows(spark, d), 'garantie "service comptable"', AS_OF, limit=None))


@query(_search_sql([], "created_at >= TIMESTAMPTZ '2024-06-01 00:00:00+00' AND created_at <= TIMESTAMPTZ '2025-06-01 00:00:00+00' AND list_contains(" + toks("type") + ", 'facture')", limit=None))
def search_filtered(spark, d):
    """No words, only a type and a period."""
    return _hits(S.search(search_rows(spark, d), "", AS_OF, type="facture", since="2024-06-01", until="2025-06-01", limit=None))


@query(f"SELECT id, d.revision, s.score FROM ({_search_sql(['facture', 'filtres'])}) s JOIN {DOCS} d USING (id) WHERE d.deleted_at IS NULL")
def search_live_documents(spark, d):
    """Hits looked up in the library, trashed ones dropped after the limit."""
    hits = _hits(S.search(search_rows(spark, d), "facture filtres", AS_OF))
    return hits.join(R.live(docs(spark, d)).select("id", "revision"), "id").select("id", "revision", "score")


@query(
    "SELECT field, count(*)::BIGINT AS postings, count(DISTINCT token)::BIGINT AS tokens FROM (" + " UNION ALL ".join(f"SELECT id, '{k}' AS field, unnest({toks(c)}) AS token FROM {SEARCH}" for k, c in (("title", "title"), ("notes", "notes"), ("type", "type"), ("content", "content"), ("folder", "folder_path"), ("tags", "array_to_string(tags, ' ')"))) + ") GROUP BY field"
)
def index_statistics(spark, d):
    """Size of the inverted index by field."""
    p = S.build_postings(search_rows(spark, d)).where(F.col("field").isin("title", "notes", "type", "content", "folder", "tags"))
    return p.groupBy("field").agg(F.count("*").alias("postings"), F.countDistinct("token").alias("tokens"))


@query(f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def normalized_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("norm"))


@query(f"SELECT a.issuer_id AS a, b.issuer_id AS b, levenshtein(a.n, b.n)::INTEGER AS distance FROM (SELECT issuer_id, {norm('name')} AS n FROM issuers) a JOIN (SELECT issuer_id, {norm('name')} AS n FROM issuers) b ON a.issuer_id < b.issuer_id WHERE levenshtein(a.n, b.n) <= 6")
def name_distances(spark, d):
    n = table(spark, d, "issuers").select("issuer_id", T.normalize(F.col("name")).alias("n"))
    a, b = n.select(F.col("issuer_id").alias("a"), F.col("n").alias("na")), n.select(F.col("issuer_id").alias("b"), F.col("n").alias("nb"))
    # of seven pieces one survives six edits, moved by six places at most; the probes of the other name meet it by key
    piece = lambda c, k: F.struct(F.lit(k).alias("k"), F.length(c).alias("long"), F.substring(c, F.floor(F.length(c) * k / 7).cast("int") + 1, (F.floor(F.length(c) * (k + 1) / 7) - F.floor(F.length(c) * k / 7)).cast("int")).alias("piece"))
    cut = a.select("a", "na", F.explode(F.array(*[piece(F.col("na"), k) for k in range(7)])).alias("p")).select("a", "na", "p.*")
    spans = lambda long, k: (F.floor(long * k / 7), F.floor(long * (k + 1) / 7) - F.floor(long * k / 7))
    probe = b.select("b", "nb", F.explode(F.sequence(F.greatest(F.length("nb") - 6, F.lit(0)), F.length("nb") + 6)).alias("long")).select("*", F.explode(F.array(*[F.lit(k) for k in range(7)])).alias("k"))
    at, size = spans(F.col("long"), F.col("k"))
    probe = probe.select("b", "nb", "long", "k", size.cast("int").alias("size"), F.explode(F.sequence(F.greatest(at - 6, F.lit(0)), at + 6)).alias("at"))
    probe = probe.select("b", "nb", "long", "k", F.expr("substring(nb, cast(at as int) + 1, size)").alias("piece")).distinct()
    pairs = cut.join(probe, ["long", "k", "piece"]).where("a < b").select("a", "b", "na", "nb").distinct()
    return pairs.select("a", "b", T.edit_distance(F.col("na"), F.col("nb"), 6).alias("distance")).where("distance <= 6")


# -- repository -----------------------------------------------------------------------------------------------------------------
@query(f"SELECT id, title, folder_id, revision FROM {DOCS} WHERE deleted_at IS NULL")
def live_documents(spark, d):
    return R.live(docs(spark, d)).select("id", "title", "folder_id", "revision")


@query(f"SELECT id, greatest(0, 30 - floor((epoch(TIMESTAMPTZ '{AS_OF}+00') - epoch(deleted_at)) / 86400))::BIGINT AS days_left FROM {DOCS} WHERE deleted_at IS NOT NULL")
def trash_days_left(spark, d):
    return R.trash(docs(spark, d)).select("id", R.days_left(F.col("deleted_at"), AS_OF).alias("days_left"))


@query(f"SELECT count(*)::BIGINT AS kept, count(deleted_at)::BIGINT AS trashed FROM {DOCS} WHERE deleted_at IS NULL OR deleted_at >= TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 30 DAYS")
def after_retention(spark, d):
    return R.after_retention(docs(spark, d), AS_OF).agg(F.count("*").alias("kept"), F.count("deleted_at").alias("trashed"))


@query(f"SELECT id FROM {DOCS} WHERE deleted_at IS NULL AND folder_id IS NULL")
def root_documents(spark, d):
    return R.in_folder(docs(spark, d), None).select("id")


@query("SELECT id, name FROM folders WHERE deleted_at IS NULL AND parent_id IS NULL")
def root_folders(spark, d):
    return R.subfolders(table(spark, d, "folders"), None).select("id", "name")


@query("SELECT id, name FROM folders WHERE deleted_at IS NOT NULL")
def trashed_folders(spark, d):
    return R.trash(table(spark, d, "folders")).select("id", "name")


@query(f"SELECT id, locked, coalesce(page_count, 0)::INTEGER AS pages FROM {DOCS} WHERE favorite OR locked")
def favorites_and_locked(spark, d):
    return docs(spark, d).where("favorite or locked").select("id", "locked", F.coalesce("page_count", F.lit(0)).cast("int").alias("pages"))


@query(f"SELECT DISTINCT unnest(tags) AS tag FROM {DOCS} WHERE deleted_at IS NULL")
def all_tags(spark, d):
    return R.all_tags(docs(spark, d))


@query(f"SELECT tag FROM (SELECT DISTINCT unnest(tags) AS tag FROM {DOCS} WHERE deleted_at IS NULL) WHERE starts_with(tag, 'c') AND tag <> 'courrier' ORDER BY tag LIMIT 8")
def tag_suggestions(spark, d):
    return R.tag_suggestions(docs(spark, d), "c", ["courrier"])


@query(f"SELECT DISTINCT kind FROM {DOCS} WHERE deleted_at IS NULL AND kind IS NOT NULL")
def kinds(spark, d):
    return R.live(docs(spark, d)).where("kind is not null").select("kind").distinct()


@query(f"SELECT id, floor(epoch(greatest(updated_at, coalesce(opened_at, updated_at))))::BIGINT AS used_s FROM {DOCS} WHERE deleted_at IS NULL ORDER BY greatest(updated_at, coalesce(opened_at, updated_at)) DESC, id LIMIT 12")
def recent_documents(spark, d):
    return R.recent(docs(spark, d)).select("id", F.unix_seconds("last_used").alias("used_s"))


@query(f"SELECT id, row_number() OVER (ORDER BY size_bytes DESC, updated_at DESC, id) AS place FROM {DOCS} ORDER BY place LIMIT 50")
def largest_documents(spark, d):
    """A top-k report of the fifty largest, with their places."""
    top = R.sort_documents(docs(spark, d), "size").limit(50)
    from pyspark.sql import Window as W

    return top.select("id", F.row_number().over(W.orderBy(F.desc("size_bytes"), F.desc("updated_at"), "id")).cast("bigint").alias("place"))


_ONCE = "(SELECT DISTINCT ON (id) * FROM history_entries ORDER BY id, received_at, happened_at)"


@query(f"SELECT id, doc_id, history_action FROM {_ONCE} ORDER BY happened_at DESC, id DESC LIMIT 200")
def history(spark, d):
    return R.history(table(spark, d, "history_entries")).select("id", "doc_id", "history_action")


@query(f"SELECT id FROM (SELECT * FROM {_ONCE} ORDER BY happened_at DESC, id DESC LIMIT 300) WHERE history_action = 'opened'")
def history_filtered(spark, d):
    return R.history_filtered(table(spark, d, "history_entries"), "opened").select("id")


@query(f"SELECT history_action, strftime(happened_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*)::BIGINT AS entries, count(DISTINCT doc_id)::BIGINT AS documents FROM {_ONCE} GROUP BY 1, 2")
def history_by_month(spark, d):
    """Entries, each once, by action and month; the hot document's entries are combined before the shuffle."""
    once = table(spark, d, "history_entries").groupBy("id").agg(F.min_by(F.struct("happened_at", "history_action", "doc_id"), F.struct("received_at", "happened_at")).alias("r")).select("r.*")
    return once.groupBy("history_action", F.date_format("happened_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("entries"), F.countDistinct("doc_id").alias("documents"))


_TREE = "WITH RECURSIVE up AS (SELECT id, id AS ancestor, name AS part, 0 AS depth FROM folders UNION ALL SELECT u.id, f.parent_id, p.name, u.depth + 1 FROM up u JOIN folders f ON f.id = u.ancestor JOIN folders p ON p.id = f.parent_id WHERE u.depth < 64)"


@query(f"{_TREE} SELECT id, string_agg(part, ' / ' ORDER BY depth DESC) AS path FROM up GROUP BY id")
def folder_paths(spark, d):
    return H.folder_paths(table(spark, d, "folders"))


@query(f"{_TREE} SELECT ancestor, count(*)::BIGINT AS below, max(depth)::INTEGER AS depth FROM up WHERE depth > 0 GROUP BY ancestor")
def folder_descendants(spark, d):
    return H.closure(table(spark, d, "folders")).where("depth > 0").groupBy("ancestor").agg(F.count("*").alias("below"), F.max("depth").alias("depth"))


@query(f"{_TREE} SELECT ancestor AS folder_id, count(*)::BIGINT AS documents, sum(size_bytes)::BIGINT AS bytes FROM up JOIN {DOCS} d ON d.folder_id = up.id WHERE d.deleted_at IS NULL GROUP BY ancestor")
def folder_totals(spark, d):
    """Live documents and their bytes of each folder with all folders below it."""
    per = R.folder_summary(docs(spark, d)).select(F.col("folder_id").alias("id"), "documents", "bytes")
    return H.closure(table(spark, d, "folders")).join(per, "id").groupBy(F.col("ancestor").alias("folder_id")).agg(F.sum("documents").alias("documents"), F.sum("bytes").alias("bytes"))


@query(f"SELECT page_id AS blob_id FROM {PAGES} p WHERE NOT EXISTS (SELECT 1 FROM {DOCS} d WHERE d.id = p.doc_id AND d.deleted_at IS NULL)")
def unreferenced_pages(spark, d):
    """Pages that no live document refers to: the garbage a collection would remove."""
    p = page_rows(spark, d).select(F.col("page_id").alias("blob_id"), "doc_id")
    used = p.join(R.live(docs(spark, d)).select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return R.unreferenced(p.select("blob_id"), used)


@query("SELECT id, revision, title FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision DESC, updated_at DESC, title DESC) AS r FROM (SELECT DISTINCT * FROM library_docs)) WHERE r = 1")
def merged_backup(spark, d):
    """Old and new versions merged by revision, as a backup is read back."""
    t = table(spark, d, "library_docs").select("id", "revision", "title", "updated_at").distinct()
    first = t.groupBy("id").agg(F.min_by(F.struct(*t.columns), F.struct("revision", "updated_at", "title")).alias("r")).select("r.*")
    best = t.groupBy("id").agg(F.max_by(F.struct(*t.columns), F.struct("revision", "updated_at", "title")).alias("r")).select("r.*")
    return R.merge_by(first, best, "id", "revision").select("id", "revision", "title")


@query(f"SELECT id, regexp_matches(trim(title), '(?i)^(scan|document|import|numérisation|page)\\b[\\s\\d:/.,h-]*$') OR starts_with(title, 'Scan du ') AS generic, CASE source WHEN 'pdf' THEN 'PDF' WHEN 'image' THEN 'Image' WHEN 'docx' THEN 'Word' WHEN 'xlsx' THEN 'Excel' WHEN 'pptx' THEN 'PowerPoint' WHEN 'txt' THEN 'Texte' ELSE 'Scan' END AS label FROM {DOCS} WHERE title IS NOT NULL")
def titles_and_labels(spark, d):
    return docs(spark, d).where("title is not null").select("id", A.is_default_title(F.col("title")).alias("generic"), R.format_label(F.col("source")).alias("label"))


@query(f"SELECT id, CASE WHEN size_bytes < 1024 THEN size_bytes || ' o' WHEN size_bytes < 1048576 THEN floor(size_bytes / 1024 + 0.5)::BIGINT || ' Ko' WHEN size_bytes < 1073741824 THEN replace(format('{{:.1f}} Mo', size_bytes / 1048576.0), '.', ',') ELSE replace(format('{{:.2f}} Go', size_bytes / 1073741824.0), '.', ',') END AS size FROM {DOCS}")
def readable_sizes(spark, d):
    return docs(spark, d).select("id", A.format_bytes(F.col("size_bytes")).alias("size"))


# -- pages as ordered lists -------------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_index, page_id) AS text FROM {PAGES} WHERE length(text) > 0 GROUP BY doc_id")
def document_texts(spark, d):
    """Page texts joined in order. A document of many pages is one value by nature; its pages meet pre-sorted."""
    p = page_rows(spark, d).where("length(text) > 0")
    pages = F.transform(F.sort_array(F.collect_list(F.struct("page_index", "page_id", "text"))), lambda x: x["text"])
    return p.groupBy("doc_id").agg(P.document_text(pages).alias("text"))


@query(f"SELECT page_id, CASE WHEN n = 0 THEN 0 ELSE (page_index // 2) END::INTEGER AS part FROM (SELECT page_id, page_index, count(*) OVER (PARTITION BY doc_id) - 1 AS n FROM {PAGES})")
def split_parts(spark, d):
    """Which part of two pages each page falls into when its document is split."""
    return page_rows(spark, d).select("page_id", F.floor(F.col("page_index") / 2).cast("int").alias("part"))


@query(f"SELECT doc_id, list_transform(list(page_id ORDER BY page_index DESC, page_id DESC), lambda x: x)::VARCHAR AS pages FROM {PAGES} GROUP BY doc_id")
def reversed_pages(spark, d):
    """Page lists in reverse order."""
    p = page_rows(spark, d)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("page_index", "page_id")), asc=False), lambda x: x["page_id"])
    return p.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]")).alias("pages"))


@query(f"SELECT doc_id, sum(CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END)::BIGINT AS words FROM {PAGES} GROUP BY doc_id")
def word_counts(spark, d):
    return page_rows(spark, d).select("doc_id", A.word_count(F.coalesce("text", F.lit(""))).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("words"))


@query("SELECT page_id, count(*)::BIGINT AS words, round(avg(confidence), 6) AS confidence FROM (SELECT DISTINCT page_id, word_index, confidence FROM ocr_words) GROUP BY page_id")
def page_confidence(spark, d):
    """Words and mean confidence of each page; words delivered twice count once."""
    w = table(spark, d, "ocr_words").select("page_id", "word_index", "confidence").distinct()
    return w.groupBy("page_id").agg(F.count("*").alias("words"), F.round(F.avg("confidence"), 6).alias("confidence"))


# -- text analytics -------------------------------------------------------------------------------------------------------------
_CUR = "CASE WHEN regexp_matches(text, '€|(?i)(^|[^a-zA-Z0-9_])eur(os?)?([^a-zA-Z0-9_]|$)') THEN 'EUR' WHEN regexp_matches(text, '\\$|(?i)(^|[^a-zA-Z0-9_])usd([^a-zA-Z0-9_]|$)') THEN 'USD' WHEN regexp_matches(text, '£|(?i)(^|[^a-zA-Z0-9_])gbp([^a-zA-Z0-9_]|$)') THEN 'GBP' WHEN regexp_matches(text, '(?i)(^|[^a-zA-Z0-9_])chf([^a-zA-Z0-9_]|$)') THEN 'CHF' END"


@query(f"SELECT doc_id, {_CUR} AS currency, nullif(regexp_replace(regexp_extract(text, '(?i)(?:facture|invoice|factura|rechnung|fattura|re[cç]u|ticket)\\s*(?:n[°o.º]*|no\\.?|num(?:ero|éro)?\\.?|#|nr\\.?)\\s*:?\\s*([A-Z0-9][A-Z0-9\\-/_.]{{2,24}})', 1), '\\.$', ''), '') AS number FROM documents")
def currencies_and_numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", A.currency(F.col("text")).alias("currency"), A.invoice_number(F.col("text")).alias("number"))


def _classify_sql() -> str:
    def count(w: str) -> str:
        w = f" {w.replace(' ', '  ')} "
        return f"least(3, (length(n) - length(replace(n, '{w}', ''))) // {len(w)})"

    def score(kind: str) -> str:
        words = A.KINDS[kind][1]
        return " + ".join(f"{2 if ' ' in w else 1} * {count(w)}" for w in words) + f" + CASE WHEN len(list_filter(h, lambda x: x = '{words[0]}' OR starts_with(x, '{words[0]} '))) > 0 THEN 3 ELSE 0 END"

    head = "list_transform(string_split(text, chr(10))[1:8], lambda x: " + norm("x") + ")"
    cols = ", ".join(f"{score(k)} AS \"{k}\"" for k in A.KINDS)
    names = list(A.KINDS)
    best = "greatest(" + ", ".join(f'"{k}"' for k in names) + ")"
    pick = " ".join(f"WHEN \"{k}\" = {best} THEN '{k}'" for k in names)
    # every space doubled, so that neighbouring words can both be counted
    return f"SELECT doc_id, CASE WHEN {best} < 4 THEN NULL {pick} END AS kind FROM (SELECT doc_id, {cols} FROM (SELECT doc_id, replace(' ' || {norm('text')} || ' ', ' ', '  ') AS n, {head} AS h FROM documents))"


@query(_classify_sql())
def classified_documents(spark, d):
    """The kind of every document by its words."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", A.classify(F.col("text")).alias("kind"))


@query()
def invoices_from_text(spark, d):
    """Invoice data, title and tags read from every document."""
    df = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "text", A.classify(F.col("text")).alias("kind"), A.invoice_data(F.col("text")).alias("inv"))
    return df.select("doc_id", "kind", "inv.*", A.suggest_title(F.col("text"), F.col("kind"), F.col("inv")).alias("title"), F.array_join(A.suggest_tags(F.col("text"), F.col("kind"), F.col("inv")), ",").alias("tags"))


@query("SELECT doc_id, total_ttc, CAST(replace(replace(replace(replace(format('{:,.2f}', total_ttc), ',', '_'), '.', ','), '_', ''), ',', '.') AS DOUBLE) AS parsed FROM (SELECT DISTINCT doc_id, total_ttc FROM invoices WHERE total_ttc IS NOT NULL)")
def parsed_amounts(spark, d):
    """Amounts written the French way and read back."""
    inv = table(spark, d, "invoices").where("total_ttc is not null").select("doc_id", "total_ttc").distinct()
    written = F.translate(F.format_number("total_ttc", 2), ",.", " ,")
    return inv.select("doc_id", "total_ttc", A.parse_amount(written).alias("parsed"))


@query("SELECT currency, count(*)::BIGINT AS invoices, round(sum(total_ht), 2) AS ht, round(sum(vat), 2) AS vat, round(sum(total_ttc), 2) AS ttc, count(*) FILTER (WHERE invoice_date IS NOT NULL AND try_cast(invoice_date AS DATE) IS NULL)::BIGINT AS impossible_dates FROM (SELECT DISTINCT * FROM invoices) GROUP BY currency")
def invoice_totals(spark, d):
    inv = table(spark, d, "invoices").distinct()
    return inv.groupBy("currency").agg(
        F.count("*").alias("invoices"), F.round(F.sum("total_ht"), 2).alias("ht"), F.round(F.sum("vat"), 2).alias("vat"), F.round(F.sum("total_ttc"), 2).alias("ttc"),
        F.count(F.when(F.col("invoice_date").isNotNull() & F.col("invoice_date").try_cast("date").isNull(), 1)).alias("impossible_dates"),
    )


@query(
    f"WITH a AS (SELECT id, trim(regexp_replace(regexp_replace(list_last(string_split_regex(title, '[\\\\/]')), '[\\x00-\\x1f\\x7f<>:\"|?*]', ' ', 'g'), '[\\s\u00a0]+', ' ', 'g')) AS s FROM {DOCS}), b AS (SELECT id, regexp_replace(regexp_replace(s, '^\\.+', ''), '[. ]+$', '') AS s FROM a), "
    "c AS (SELECT id, substr(CASE WHEN regexp_matches(CASE WHEN strpos(s, '.') > 1 THEN regexp_replace(s, '\\.[^.]*$', '') ELSE s END, '(?i)^(con|prn|aux|nul|com\\d|lpt\\d)$') THEN '_' || s ELSE s END, 1, 120) AS s FROM b) "
    "SELECT id, regexp_replace(CASE WHEN length(s) > 0 THEN s ELSE 'document' END, '(?i)\\.(pdf|jpe?g|png|txt|docx|zip)$', '') || '.pdf' AS file FROM c"
)
def export_names(spark, d):
    return docs(spark, d).select("id", A.export_file_name(F.col("title"), "pdf").alias("file"))


@query(
    "WITH t(n, name) AS (VALUES (1, 'a/b\\rapport.final.PDF'), (2, ' ..caché.txt. '), (3, 'CON'), (4, 'nul.txt'), (5, '???'), (6, ''), (7, 'x:y|z?.docx'), (8, 'archive.tar.zip'), (9, repeat('long ', 40))) "
    "SELECT n, CASE n WHEN 1 THEN 'rapport.final' WHEN 2 THEN 'caché' WHEN 3 THEN '_CON' WHEN 4 THEN '_nul' WHEN 5 THEN 'document' WHEN 6 THEN 'document' WHEN 7 THEN 'x y z ' WHEN 8 THEN 'archive.tar' ELSE substr(rtrim(name), 1, 120) END || '.pdf' AS file FROM t"
)
def export_names_of_hard_titles(spark, d):
    """Paths, reserved and missing names, points around, and names that are too long."""
    hard = [(1, "a/b\\rapport.final.PDF"), (2, " ..caché.txt. "), (3, "CON"), (4, "nul.txt"), (5, "???"), (6, ""), (7, "x:y|z?.docx"), (8, "archive.tar.zip"), (9, "long " * 40)]
    return spark.createDataFrame(hard, "n int, name string").select("n", A.export_file_name(F.col("name"), "pdf").alias("file"))


# -- images, levels, geometry ---------------------------------------------------------------------------------------------------
_BITS = "list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > embedding[i + 1] THEN 1 ELSE 0 END)"


@query(f"WITH b AS (SELECT vec_id, {_BITS} AS b FROM embeddings) SELECT x.vec_id AS a, y.vec_id AS b, list_sum(list_transform(range(1, 64), lambda i: abs(x.b[i] - y.b[i])))::INTEGER AS distance FROM b x JOIN b y ON x.vec_id < y.vec_id WHERE list_sum(list_transform(range(1, 64), lambda i: abs(x.b[i] - y.b[i]))) <= 12")
def duplicate_images(spark, d):
    """Pairs of image hashes at most 12 bits apart: hashes of neighbouring values, equal in one of 13 bands."""
    e = table(spark, d, "embeddings").select("vec_id", D.difference_hash(F.col("embedding")).alias("h"))
    return D.near_hashes(e, "vec_id", "h", 12).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "distance")


@query("SELECT p_size AS level, count(*)::BIGINT AS n FROM part GROUP BY p_size")
def level_histogram(spark, d):
    return V.histogram(table(spark, d, "part"), F.col("p_size")).select(F.col("level").cast("bigint").alias("level"), "n")


@query("WITH h AS (SELECT p_size AS v, count(*)::DOUBLE AS n FROM part GROUP BY p_size), c AS (SELECT v, sum(n) OVER (ORDER BY v) AS wb, sum(n * v) OVER (ORDER BY v) AS sb, sum(n) OVER () AS t, sum(n * v) OVER () AS s FROM h) SELECT arg_min(v, v)::BIGINT AS threshold FROM c WHERE wb < t AND wb * (t - wb) * (sb / wb - (s - sb) / (t - wb)) ^ 2 >= (SELECT max(wb * (t - wb) * (sb / wb - (s - sb) / (t - wb)) ^ 2) FROM c WHERE wb < t) - 1e-6")
def otsu_level(spark, d):
    """The level that parts two classes best."""
    return V.otsu(V.histogram(table(spark, d, "part"), F.col("p_size"))).select(F.col("threshold").cast("bigint").alias("threshold"))


@query("SELECT p, min(v)::BIGINT AS level FROM (SELECT l_quantity::BIGINT AS v, sum(count(*)) OVER (ORDER BY l_quantity::BIGINT) AS c, sum(count(*)) OVER () AS t FROM lineitem GROUP BY 1) CROSS JOIN (SELECT unnest([0.01, 0.5, 0.99]) AS p) WHERE c >= t * p GROUP BY p")
def level_percentiles(spark, d):
    h = V.histogram(table(spark, d, "lineitem"), F.col("l_quantity").cast("bigint"))
    return V.percentiles(h, [0.01, 0.5, 0.99]).select("p", F.col("level").cast("bigint").alias("level"))


@query("SELECT o_orderkey % 100 AS g, round(avg(o_custkey), 6) AS x, round(avg(o_totalprice), 6) AS y, round(cos(atan2(2 * covar_pop(o_custkey, o_totalprice), var_pop(o_custkey) - var_pop(o_totalprice)) / 2), 6) AS dx FROM orders GROUP BY 1 HAVING count(*) >= 2")
def fitted_lines(spark, d):
    o = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 100).alias("g")).agg(G.fit_line(F.col("o_custkey").cast("double"), F.col("o_totalprice")).alias("l"))
    return o.where("l is not null").select("g", F.round("l.x", 6).alias("x"), F.round("l.y", 6).alias("y"), F.round("l.dx", 6).alias("dx"))




@query("SELECT l_orderkey, l_linenumber, round(abs((l_quantity+1)*(l_tax*100) - (l_quantity+40)*(l_discount*100) + (l_quantity+40)*(l_tax*100+60) - (l_quantity+44)*(l_tax*100) + (l_quantity+44)*(l_discount*100+55) - (l_quantity-3)*(l_tax*100+60) + (l_quantity-3)*(l_discount*100) - (l_quantity+1)*(l_discount*100+55)) / 2, 6) AS area FROM lineitem")
def quad_areas(spark, d):
    """Areas of quads made of columns: arithmetic inside the generated code, no Python."""
    q, t, c = F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 100
    quad = F.array(G.point(q + 1, c), G.point(q + 40, t), G.point(q + 44, t + 60), G.point(q - 3, c + 55))
    return spread(table(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", F.round(G.polygon_area(quad), 6).alias("area"))


# -- events as frames -------------------------------------------------------------------------------------------------------------
@query("SELECT event_id, count(*) OVER w AS n_window, min(value) OVER w AS low, max(value) OVER w AS high FROM (SELECT *, epoch_ms(ts) AS ms FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW)")
def stability_window(spark, d):
    """Least and greatest value in the hour before each event of a user."""
    from parchmint.streaming.frames import look_back

    e = table(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return look_back(e, "user_id", "ms", "value", 3_600_000).select("event_id", "n_window", "low", "high")


@query()
def capture_decisions(spark, d):
    """Both state machines over events as frames: a user is a session, the value shifts the outline."""
    from parchmint.streaming.automata import Settings
    from parchmint.streaming.frames import capture_batch

    v = F.col("value") % 7
    quad = F.array(*[(F.lit(float(c)) + v).cast("double") for c in (20, 20, 300, 25, 290, 240, 15, 235)])
    frames = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("session"), (F.unix_millis(F.col("ts").cast("timestamp")) / 10000.0).cast("double").alias("t_ms"), F.when(F.col("event_type") != "error", quad).alias("quad"), F.lit(0.8).alias("score"),
        F.lit(False).alias("partial"), F.lit(False).alias("blurry"), F.lit(False).alias("too_dark"), F.lit(True).alias("enabled"),
    )
    return capture_batch(frames, Settings(450.0)).groupBy("session", "status").agg(F.count("*").alias("frames"), F.sum(F.col("fire").cast("int")).alias("captures"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
