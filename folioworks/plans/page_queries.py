"""Page planning over the pages of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks import fixtures as fx
from folioworks.functions.text import page_number_text
from folioworks.operators import pages as op
from folioworks.plans.duck_views import with_views
from folioworks.plans.registry import query


@query(
    "page_selector",
    with_views(
        "page_text",
        """SELECT revision_id, page_index FROM page_text WHERE CASE revision_id % 6
            WHEN 0 THEN true WHEN 1 THEN page_index + 1 BETWEEN 2 AND 4 WHEN 2 THEN page_index + 1 >= 3
            WHEN 3 THEN page_index % 2 = 0 WHEN 4 THEN page_index % 2 = 1 ELSE page_index + 1 IN (1, 3, 9) END""",
    ),
)
def page_selector(spark, sf_dir):
    k = F.col("revision_id") % 6
    mode = F.element_at(
        F.array(*[F.lit(m) for m in ["all", "range", "range", "odd", "even", "custom"]]), (k + 1).cast("int")
    )
    chosen = op.page_selected(
        F.col("page_index"),
        mode,
        F.when(k == 1, 2).when(k == 2, 3),
        F.when(k == 1, 4),
        F.array(F.lit(1), F.lit(3), F.lit(9)),
    )
    return fx.page_numbers(spark, sf_dir).where(chosen).select("revision_id", "page_index")


def _specs(spark, sf_dir) -> DataFrame:
    """Range specs with every kind of mistake, one per customer."""
    return fx.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS revision_id",
        "c_name AS title",
        "CAST(c_custkey % 15 + 1 AS INT) AS page_count",
        """CASE c_custkey % 10 WHEN 9 THEN '  ' WHEN 8 THEN concat('x', c_custkey, ',1')
           WHEN 7 THEN '1-2-3' ELSE concat(c_custkey % 4, '-', c_custkey % 7 + 2, ' , ', c_custkey % 11 + 1) END AS spec""",
    )


SPECS = """specs AS (SELECT c_custkey AS revision_id, c_name AS title, CAST(c_custkey % 15 + 1 AS INTEGER) AS n, c_custkey % 10 AS kind,
    c_custkey % 4 AS a, c_custkey % 7 + 2 AS b, c_custkey % 11 + 1 AS c FROM customer),
    judged AS (SELECT *, CASE WHEN kind = 9 THEN NULL
        WHEN kind = 8 THEN 'invalid page number "x' || revision_id || '"' WHEN kind = 7 THEN 'invalid range "1-2-3"'
        WHEN a < 1 THEN 'page number ' || a || ' must be ≥ 1'
        WHEN a > b THEN 'range ' || a || '-' || b || ' is reversed (must be from ≤ to)'
        WHEN b > n THEN 'page ' || b || ' is out of range (document has ' || n || ' pages)'
        WHEN c > n THEN 'page ' || c || ' is out of range (document has ' || n || ' pages)' END AS error FROM specs)"""


@query(
    "parse_ranges",
    f"""WITH {SPECS} SELECT revision_id, error, CASE WHEN kind = 9 THEN array_to_string(range(n), ',')
        WHEN error IS NULL THEN array_to_string(list_sort(list_distinct(list_concat(range(a - 1, b), [c - 1]))), ',') END AS pages
        FROM judged""",
)
def parse_ranges(spark, sf_dir):
    return op.parse_ranges(_specs(spark, sf_dir)).select(
        "revision_id", "error", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages")
    )


@query(
    "split_ranges",
    f"""WITH {SPECS}, grouped AS (SELECT revision_id, title, CASE WHEN kind = 9 THEN 'no ranges given' ELSE error END AS error,
            CASE WHEN kind <> 9 AND error IS NULL THEN [range(a - 1, b), [c - 1]] END AS groups FROM judged),
        parts AS (SELECT *, unnest(groups) AS pages, generate_subscripts(groups, 1) AS part FROM grouped WHERE error IS NULL)
        SELECT revision_id, CAST(part AS INTEGER) AS part, title || '-' || lpad(CAST(part AS VARCHAR), 3, '0') || '.pdf' AS name, error,
            CAST(position AS INTEGER) AS position, CAST(page_index AS INTEGER) AS page_index
        FROM (SELECT *, unnest(pages) AS page_index, generate_subscripts(pages, 1) - 1 AS position FROM parts)
        UNION ALL SELECT revision_id, NULL, NULL, error, NULL, NULL FROM grouped WHERE error IS NOT NULL""",
)
def split_ranges(spark, sf_dir):
    return op.split_ranges(_specs(spark, sf_dir))


@query(
    "extract_pages",
    """WITH r AS (SELECT c_custkey AS revision_id, c_name AS title, c_custkey % 15 + 1 AS n,
            [c_custkey % 5, c_custkey % 9, 0] AS pages FROM customer),
        j AS (SELECT *, list_max(pages) >= n AS bad FROM r)
        SELECT revision_id, CAST(i AS INTEGER) AS part, CAST(pages[i] AS INTEGER) AS page_index,
            title || '-00' || i || '.pdf' AS name, NULL AS error
        FROM j, (SELECT unnest([1, 2, 3]) AS i) WHERE NOT bad
        UNION ALL SELECT revision_id, NULL, NULL, NULL, 'page out of bounds' FROM j WHERE bad""",
)
def extract_pages(spark, sf_dir):
    requests = fx.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS revision_id", "c_name AS title", "c_custkey % 15 + 1 AS page_count",
        "array(CAST(c_custkey % 5 AS INT), CAST(c_custkey % 9 AS INT), 0) AS pages",
    )
    return op.extract_pages(requests)


@query(
    "split_every_n",
    with_views(
        "document_pages",
        """SELECT revision_id, CAST(page_index // 3 + 1 AS BIGINT) AS part, min(page_index) AS first_page,
            max(page_index) AS last_page, CAST(sum(byte_size) AS BIGINT) AS bytes FROM document_pages GROUP BY 1, 2""",
    ),
)
def split_every_n(spark, sf_dir):
    return op.part_summary(op.split_every_n(fx.document_pages(spark, sf_dir), 3))


@query(
    "split_by_size",
    with_views(
        "document_pages",
        """WITH folded AS (SELECT revision_id, list_reduce(list({'p': page_index, 's': byte_size} ORDER BY page_index),
            lambda a, x: CASE WHEN a.cur IS NULL OR a.cur + x.s > 5000
                THEN {'cur': x.s, 'parts': list_append(a.parts, {'first': x.p, 'last': x.p, 'bytes': x.s})}
                ELSE {'cur': a.cur + x.s, 'parts': list_append(a.parts[:-2],
                    {'first': a.parts[-1].first, 'last': x.p, 'bytes': a.cur + x.s})} END,
            {'cur': CAST(NULL AS BIGINT), 'parts': CAST([] AS STRUCT("first" INTEGER, "last" INTEGER, bytes BIGINT)[])}).parts AS parts
            FROM document_pages GROUP BY 1),
        numbered AS (SELECT revision_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS part FROM folded)
        SELECT revision_id, CAST(part AS BIGINT) AS part, x.first AS first_page, x.last AS last_page, x.bytes AS bytes FROM numbered""",
    ),
)
def split_by_size(spark, sf_dir):
    return op.part_summary(op.split_by_size(fx.document_pages(spark, sf_dir), 5000))


def outline(spark, sf_dir) -> DataFrame:
    """Three levels per document: a root without page, chapters of three pages
    (the even ones without page), and one entry per page."""
    pages = fx.page_numbers(spark, sf_dir)
    root = "revision_id * 10000"
    roots = pages.where("page_index = 0").selectExpr(
        "revision_id", f"{root} AS node_id", "CAST(NULL AS BIGINT) AS parent_id", "0 AS depth", "0 AS ord",
        "'Contents' AS title", "CAST(NULL AS INT) AS page",
    )
    chapters = pages.where("page_index % 3 = 0").selectExpr(
        "revision_id", f"{root} + 1 + page_index", f"{root} AS parent_id", "1 AS depth",
        "CAST(page_index div 3 AS INT) AS ord", "concat('Chapter ', page_index div 3) AS title",
        "CASE WHEN page_index % 2 = 0 THEN NULL ELSE page_index END AS page",
    )
    entries = pages.selectExpr(
        "revision_id", f"{root} + 5000 + page_index", f"{root} + 1 + page_index - page_index % 3 AS parent_id",
        "2 AS depth", "page_index % 3 AS ord", "concat('Section ', page_index) AS title", "page_index AS page",
    )
    return roots.union(chapters).union(entries)


OUTLINE = """outline AS (SELECT revision_id, revision_id * 10000 AS node_id, NULL AS parent_id, 0 AS depth, NULL AS page
        FROM page_text WHERE page_index = 0
    UNION ALL SELECT revision_id, revision_id * 10000 + 1 + page_index, revision_id * 10000, 1,
        CASE WHEN page_index % 2 = 0 THEN NULL ELSE page_index END FROM page_text WHERE page_index % 3 = 0
    UNION ALL SELECT revision_id, revision_id * 10000 + 5000 + page_index,
        revision_id * 10000 + 1 + page_index - page_index % 3, 2, page_index FROM page_text)"""


@query(
    "split_at_bookmarks",
    with_views(
        "page_text",
        f"""WITH {OUTLINE}, counted AS (SELECT revision_id, CAST(count(*) AS INTEGER) AS n FROM page_text GROUP BY 1),
        points AS (SELECT DISTINCT revision_id, page FROM outline WHERE depth = 1 AND page IS NOT NULL),
        starts AS (SELECT * FROM points UNION SELECT DISTINCT revision_id, 0 FROM points),
        parts AS (SELECT revision_id, page, row_number() OVER w AS part, lead(page) OVER w AS nxt
            FROM starts WINDOW w AS (PARTITION BY revision_id ORDER BY page))
        SELECT revision_id, CAST(part AS INTEGER) AS part, page AS first_page, CAST(coalesce(nxt - 1, n - 1) AS INTEGER) AS last_page,
            NULL AS error FROM parts JOIN counted USING (revision_id)
        UNION ALL SELECT revision_id, NULL, NULL, NULL, 'no bookmarks on level 2' FROM counted
            WHERE revision_id NOT IN (SELECT revision_id FROM points)""",
    ),
)
def split_at_bookmarks(spark, sf_dir):
    counts = fx.page_numbers(spark, sf_dir).groupBy("revision_id").agg(F.count("*").cast("int").alias("page_count"))
    return op.split_at_bookmarks(counts, outline(spark, sf_dir), 2)


@query(
    "outline_filter",
    with_views(
        "page_text",
        f"""WITH {OUTLINE}, kept AS (SELECT revision_id, page_index AS page, CAST(page_index - page_index // 3 AS INTEGER) AS new_idx
            FROM page_text WHERE page_index % 3 <> 2),
        o AS (SELECT o.*, k.new_idx FROM outline o LEFT JOIN kept k USING (revision_id, page)),
        leaf AS (SELECT * FROM o WHERE depth = 2 AND new_idx IS NOT NULL),
        mid AS (SELECT * FROM o WHERE depth = 1 AND (new_idx IS NOT NULL OR (page IS NULL AND node_id IN (SELECT parent_id FROM leaf)))),
        top AS (SELECT * FROM o WHERE depth = 0 AND node_id IN (SELECT parent_id FROM mid)),
        kept_mid AS (SELECT * FROM mid WHERE parent_id IN (SELECT node_id FROM top)),
        kept_leaf AS (SELECT * FROM leaf WHERE parent_id IN (SELECT node_id FROM kept_mid))
        SELECT revision_id, node_id, depth, new_idx + 10 AS page FROM (FROM top UNION ALL FROM kept_mid UNION ALL FROM kept_leaf)""",
    ),
)
def outline_filter(spark, sf_dir):
    kept = fx.page_numbers(spark, sf_dir).where("page_index % 3 <> 2").selectExpr(
        "revision_id", "page_index AS old_idx", "CAST(page_index - page_index div 3 AS INT) AS new_idx"
    )
    return op.filter_outline(outline(spark, sf_dir), kept, offset=10).select("revision_id", "node_id", "depth", "page")


def _sources(spark, sf_dir) -> DataFrame:
    """The orders of a customer as the sources of one merge."""
    return fx.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS merge_id", "o_orderkey AS ord", "1 + o_orderkey % 9 AS page_count"
    )


SOURCES = """sources AS (SELECT o_custkey AS merge_id, o_orderkey AS ord, 1 + o_orderkey % 9 AS page_count FROM orders),
    sized AS (SELECT *, count(*) OVER (PARTITION BY merge_id) AS k, CAST(coalesce(sum(page_count) OVER (PARTITION BY merge_id
        ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM sources)"""


@query(
    "merge_offsets",
    f"""WITH {SOURCES} SELECT merge_id, ord, page_count, before AS page_offset, CAST(NULL AS VARCHAR) AS error FROM sized""",
)
def merge_offsets(spark, sf_dir):
    return op.page_offsets(_sources(spark, sf_dir))


@query(
    "merge_offsets_limited",
    f"""WITH {SOURCES} SELECT merge_id, ord, page_count, CASE WHEN k <= 12 THEN before END AS page_offset,
        CASE WHEN k > 12 THEN 'too many sources: ' || k || ' (at most 12)' END AS error FROM sized""",
)
def merge_offsets_limited(spark, sf_dir):
    return op.page_offsets(_sources(spark, sf_dir), max_sources=12)


@query(
    "merge_labels_continue",
    f"""WITH {SOURCES}, p AS (SELECT *, unnest(range(page_count)) AS i FROM sized)
        SELECT merge_id, ord, before + i AS page, before + i + 1 AS label FROM p""",
)
def merge_labels_continue(spark, sf_dir):
    return op.page_labels(op.page_offsets(_sources(spark, sf_dir)), True)


@query(
    "merge_labels_restart",
    f"""WITH {SOURCES}, p AS (SELECT *, unnest(range(page_count)) AS i FROM sized)
        SELECT merge_id, ord, before + i AS page, i + 1 AS label FROM p""",
)
def merge_labels_restart(spark, sf_dir):
    return op.page_labels(op.page_offsets(_sources(spark, sf_dir)), False)


def page_maps(spark, sf_dir) -> DataFrame:
    """A page operation per document, chosen by its id, as a page map."""
    docs = fx.table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS old_revision_id",
        "doc_id + 1000000 AS new_revision_id",
        "CAST((size(split(text, '\\n')) - 1) div 8 + 1 AS INT) AS n",
        "CASE doc_id % 5 WHEN 0 THEN 'insert_blank' WHEN 1 THEN 'reverse' WHEN 2 THEN 'replace' "
        "WHEN 3 THEN 'background' ELSE 'extract' END AS operation",
    )
    order = F.expr(
        "CASE WHEN operation = 'reverse' THEN reverse(sequence(0, n - 1)) "
        "WHEN operation = 'extract' THEN array(0, n - 1, 0) ELSE sequence(0, n - 1) END"
    )
    mapped = op.preserved_map(F.col("operation"), order, F.col("n"), F.expr("n div 2"), F.lit(2))
    return docs.select("old_revision_id", "new_revision_id", F.inline(mapped))


MAPS = """d AS (SELECT revision_id AS old_revision_id, revision_id + 1000000 AS new_revision_id, CAST(count(*) AS INTEGER) AS n
        FROM page_text GROUP BY 1),
    moves AS (SELECT d.*, CASE old_revision_id % 5
        WHEN 0 THEN list_transform(range(n + 1), lambda i: {'new': i, 'old': CASE WHEN i < n // 2 THEN i WHEN i = n // 2 THEN NULL ELSE i - 1 END})
        WHEN 1 THEN list_transform(range(n), lambda i: {'new': i, 'old': n - 1 - i})
        WHEN 2 THEN list_transform(range(n + 2), lambda i: {'new': i, 'old': CASE WHEN i < n // 2 THEN i WHEN i < n // 2 + 2 THEN NULL ELSE i - 2 END})
        WHEN 3 THEN list_transform(range(n), lambda i: {'new': i, 'old': i})
        ELSE [{'new': 0, 'old': 0}, {'new': 1, 'old': n - 1}, {'new': 2, 'old': 0}] END AS moves FROM d),
    page_map AS (SELECT old_revision_id, new_revision_id, CAST(m.new AS INTEGER) AS new_idx, CAST(m.old AS INTEGER) AS old_idx
        FROM (SELECT *, unnest(moves) AS m FROM moves))"""


@query("page_maps", with_views("page_text", f"WITH {MAPS} FROM page_map"))
def page_maps_query(spark, sf_dir):
    return page_maps(spark, sf_dir)


@query(
    "carry_forward",
    with_views(
        "page_text document_pages",
        f"""WITH {MAPS} SELECT m.new_revision_id AS revision_id, m.new_idx AS page_index, p.width, p.height,
            coalesce(p.has_text, false) AS has_text, coalesce(t.content, '') AS content
        FROM page_map m LEFT JOIN document_pages p ON p.revision_id = m.old_revision_id AND p.page_index = m.old_idx
        LEFT JOIN page_text t ON t.revision_id = m.old_revision_id AND t.page_index = m.old_idx AND t.revision_id % 7 <> 0""",
    ),
)
def carry_forward(spark, sf_dir):
    text = fx.page_text(spark, sf_dir)
    carried = op.carry_forward(
        page_maps(spark, sf_dir), fx.document_pages(spark, sf_dir), text.where("revision_id % 7 <> 0")
    )
    return carried.drop("spans")


@query(
    "remap_annotations",
    with_views(
        "page_text annotations",
        f"""WITH {MAPS} SELECT m.new_revision_id AS revision_id, m.new_idx AS page_index, a.annotation_id, a.kind, a.contents
        FROM annotations a JOIN page_map m ON m.old_revision_id = a.document_id AND m.old_idx = a.page_index""",
    ),
)
def remap_annotations(spark, sf_dir):
    notes = fx.annotations(spark, sf_dir).withColumnRenamed("document_id", "revision_id")
    return op.remap_annotations(notes, page_maps(spark, sf_dir)).select(
        "revision_id", "page_index", "annotation_id", "kind", "contents"
    )


@query(
    "page_numbers",
    with_views(
        "page_text",
        """WITH n AS (SELECT revision_id, page_index, revision_id % 7 AS style, revision_id * 7 % 4100 + page_index AS n,
            count(*) OVER (PARTITION BY revision_id) AS pages FROM page_text),
        r AS (SELECT *, CASE WHEN n <= 0 THEN '0' WHEN n >= 4000 THEN CAST(n AS VARCHAR) ELSE repeat('M', n // 1000)
            || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][n // 100 % 10 + 1]
            || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][n // 10 % 10 + 1]
            || ['','I','II','III','IV','V','VI','VII','VIII','IX'][n % 10 + 1] END AS roman,
            CASE WHEN n <= 0 THEN CAST(n AS VARCHAR) WHEN n <= 26 THEN chr(CAST(64 + n AS INTEGER))
                WHEN n <= 702 THEN chr(CAST(65 + (n - 27) // 26 AS INTEGER)) || chr(CAST(65 + (n - 1) % 26 AS INTEGER))
                ELSE chr(CAST(65 + (n - 703) // 676 AS INTEGER)) || chr(CAST(65 + (n - 703) // 26 % 26 AS INTEGER))
                    || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) END AS letters FROM n)
        SELECT revision_id, page_index, CASE style WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN lower(roman) WHEN 2 THEN roman
            WHEN 3 THEN lower(letters) WHEN 4 THEN letters WHEN 5 THEN 'Page ' || n || ' of ' || pages ELSE 'draft' END AS label FROM r""",
    ),
)
def page_numbers(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS revision_id",
        "(size(split(text, '\\n')) - 1) div 8 + 1 AS pages",
        "element_at(array('1', 'i', 'I', 'a', 'A', 'page_of', 'draft'), CAST(doc_id % 7 + 1 AS INT)) AS style",
        "doc_id * 7 % 4100 AS start_at",
    )
    pages = docs.withColumn("page_index", F.explode(F.expr("sequence(0, CAST(pages - 1 AS INT))")))
    return pages.select(
        "revision_id",
        "page_index",
        page_number_text(F.col("page_index"), F.col("pages"), F.col("style"), F.col("start_at")).alias("label"),
    )
