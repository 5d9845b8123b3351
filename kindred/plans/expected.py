"""The queries of kindred.plans.checks stated in SQL over the same tables, for value checks."""

from kindred.constants import (
    BGR_MEAN,
    CLASS_NAMES,
    KOREAN_TO_ENGLISH,
    NORM_ADDEND,
    NORM_FLOOR,
    RGB_MEAN,
    RGB_STD,
    STAGE_WEIGHTS,
)
from kindred.plans.derived import BACKBONES, CHANNELS, STAGES

KOREAN = list(KOREAN_TO_ENGLISH)


def sql_list(values) -> str:
    quoted = [f"'{v}'" if isinstance(v, str) else repr(v) for v in values]
    return "[" + ", ".join(quoted) + "]"


def picked(values, index: str) -> str:
    """Element of a literal list by position from 0; null beyond its end."""
    return f"{sql_list(values)}[CAST({index} AS INTEGER) + 1]"


def with_all(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


# Vectors

VECTORS = "v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def unnested(source: str, values: str, digits: int, table: str = "v") -> str:
    """vec_id, position, value of a list expression."""
    return f"""SELECT vec_id, CAST(position - 1 AS INTEGER) AS position, round(value, {digits}) AS value FROM (
      SELECT vec_id, unnest({values}) AS value, generate_subscripts({values}, 1) AS position FROM {source}) x"""


STAGE_STARTS = [sum(STAGES[:i]) for i in range(len(STAGES))]
SIGNATURE_PARTS = [
    f"list_transform(e[{a + 1}:{a + n}], lambda x: x / (sqrt(list_dot_product(e[{a + 1}:{a + n}], e[{a + 1}:{a + n}])) + {NORM_ADDEND}) * {w})"
    for a, n, w in zip(STAGE_STARTS, STAGES, STAGE_WEIGHTS)
]
SIGNATURES = (
    f"sg AS MATERIALIZED (SELECT vec_id, label, {' || '.join(SIGNATURE_PARTS)} AS s FROM v)"
)
CHANNEL_LISTS = f"""ch AS MATERIALIZED (SELECT vec_id, label, list(pos ORDER BY x DESC, pos)[1:{CHANNELS}] AS c FROM (
    SELECT vec_id, label, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS pos FROM sg) y GROUP BY vec_id, label)"""
BITS = """bt AS MATERIALIZED (SELECT vec_id, label, list_transform(e, lambda x:
    CASE WHEN x >= coalesce(list_sum(list_filter(e, lambda z: z <> 0)) / len(list_filter(e, lambda z: z <> 0)), 0) THEN 1 ELSE 0 END) AS b FROM v)"""


def number_of_bits(start: str, width: int) -> str:
    return f"list_sum(list_transform(range({width}), lambda i: b[{start} + i + 1] * CAST(pow(2, {width - 1} - i) AS BIGINT)))"


PACKED = f"""pk AS MATERIALIZED (SELECT vec_id, label, b,
    list_aggregate(list_transform(range(8), lambda j: printf('%02X', CAST({number_of_bits('j * 8', 8)} AS BIGINT))), 'string_agg', '') AS packed,
    list_transform(range(2), lambda j: CAST({number_of_bits('j * 32', 32)} AS BIGINT)) AS words FROM bt)"""
PIXELS = "px AS MATERIALIZED (SELECT vec_id, list_transform(e[1:48], lambda x: floor(abs(x) * 255)) AS p FROM v)"

# Selection: one step per further pick, all groups at once.

UNITS = f"""u AS MATERIALIZED (SELECT vec_id AS id, label AS grp,
    list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), {NORM_FLOOR})) AS u FROM v)"""


def selection(n: int) -> str:
    """Tables up to picks(grp, ordinal, id, ms)."""
    parts = [
        VECTORS,
        UNITS,
        "p0 AS MATERIALIZED (SELECT grp, min(id) AS id, CAST(NULL AS DOUBLE) AS ms FROM u GROUP BY grp)",
        "s0 AS MATERIALIZED (SELECT id, grp, u, CAST(-2 AS DOUBLE) AS ms FROM u)",
    ]
    for i in range(1, n):
        parts += [
            f"""s{i} AS MATERIALIZED (SELECT s.id, s.grp, s.u, greatest(s.ms,
              CASE WHEN s.id = p.id THEN 2.0 ELSE round(list_dot_product(s.u, q.u), 10) END) AS ms
              FROM s{i - 1} s JOIN p{i - 1} p ON s.grp = p.grp JOIN u q ON q.id = p.id)""",
            f"p{i} AS MATERIALIZED (SELECT grp, arg_min(id, (ms, id)) AS id, min(ms) AS ms FROM s{i} GROUP BY grp)",
        ]
    union = " UNION ALL ".join(f"SELECT grp, {i} AS ordinal, id, ms FROM p{i}" for i in range(n))
    return ",\n".join([*parts, f"picks AS MATERIALIZED ({union})"])


PAIRS = """pairs AS MATERIALIZED (SELECT q.grp, q.id AS query, i.id, round(list_dot_product(i.u, qu.u), 10) AS sim
    FROM picks q JOIN u qu ON qu.id = q.id JOIN u i ON i.grp = q.grp AND i.id <> q.id)"""


def ranked(score: str, table: str, k: int, name: str, ascending: bool = False) -> str:
    direction = "" if ascending else "DESC"
    return f"""{name} AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER
      (PARTITION BY grp, query ORDER BY {score} {direction}, id) AS INTEGER) AS rank FROM {table}) x WHERE rank <= {k})"""


NEIGHBOURS = 'SELECT grp AS "group", query, id, rank, round(sim, 6) AS similarity FROM {}'
SHARED = """shared AS MATERIALIZED (SELECT p.grp, p.query, p.id, p.sim, CAST(len(list_intersect(a.c, b.c)) AS INTEGER) AS shared
    FROM pairs p JOIN ch a ON a.vec_id = p.query JOIN ch b ON b.vec_id = p.id)"""


def distances(source: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT p.grp, p.query, p.id, p.sim, CAST(bit_count(xor(a.words[1], b.words[1]))
      + bit_count(xor(a.words[2], b.words[2])) AS INTEGER) AS distance
      FROM {source} p JOIN pk a ON a.vec_id = p.query JOIN pk b ON b.vec_id = p.id)"""


CASCADE = [
    selection(20), SIGNATURES, CHANNEL_LISTS, BITS, PACKED, PAIRS, SHARED,
    "near AS MATERIALIZED (SELECT * FROM shared WHERE shared > 0)",
    ranked("shared", "near", 30, "first_stage"),
    distances("first_stage", "d"),
    ranked("distance", "d", 20, "second_stage", ascending=True),
    "short AS (SELECT grp, query, id, sim FROM second_stage)",
    ranked("sim", "short", 10, "found"),
]

# Image lists

PART_URLS = f"""pu AS MATERIALIZED (SELECT p_partkey, CASE
    WHEN p_partkey % 8 < 5 THEN '/upload/' || {picked(KOREAN, 'p_partkey % 8')} || '/' || p_partkey || '.jpg'
    WHEN p_partkey % 8 = 5 THEN '/upload/bag/' || p_partkey || '.jpg'
    WHEN p_partkey % 8 = 6 THEN p_partkey || '.jpg'
    ELSE '/upload//upload/의류/가방_' || p_partkey || '.jpg' END AS image_url FROM part)"""


def english(url: str) -> str:
    for korean, name in KOREAN_TO_ENGLISH.items():
        url = f"replace({url}, '{korean}', '{name}')"
    return url


def url_category(url: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{e}'" for k, e in KOREAN_TO_ENGLISH.items())
    return f"CASE string_split(trim({url}, '/'), '/')[2] {whens} END"


META = f"""im AS MATERIALIZED (SELECT CAST(l_partkey AS VARCHAR) AS image_uuid,
    '/upload/' || coalesce({picked(KOREAN, 'l_suppkey % 6')}, 'etc') || '/' || l_partkey || '_' || l_suppkey || '.jpg' AS image_url
    FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1),
  meta AS MATERIALIZED (SELECT image_uuid, {english('image_url')} AS image_url, {url_category('image_url')} AS category FROM im)"""
FEATURES = """fe AS MATERIALIZED (SELECT CAST(vec_id * 5 AS VARCHAR) AS image_uuid,
    CASE WHEN label = 9 THEN e[1:32] ELSE e END AS e FROM v)"""
KNOWN = "category IN (" + ", ".join(f"'{c}'" for c in CLASS_NAMES) + ")"
SCORED = """sc AS (SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey AS name, l_quantity <= 3 AS failed,
    'quantity ' || CAST(l_quantity AS INTEGER) AS reason FROM lineitem)"""
VECTOR_CODES = """co AS MATERIALIZED (SELECT p.vec_id, p.vec_id % 17 = 0 AS failed, p.packed, v.e,
    '[' || list_aggregate(o.c, 'string_agg', ', ') || ']' AS channel_order
    FROM pk p JOIN v ON v.vec_id = p.vec_id JOIN (
      SELECT vec_id, list(pos ORDER BY x DESC, pos)[1:5] AS c FROM (
        SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS pos FROM v) y GROUP BY vec_id) o ON o.vec_id = p.vec_id)"""

# Detections

DETECTIONS = """det AS MATERIALIZED (SELECT *, x1 + (det_id * 13) % 120 - 10.0 AS x2, y1 + (det_id * 17) % 90 - 5.0 AS y2 FROM (
    SELECT user_id AS image_id, event_id AS det_id,
      CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 7 END AS class_id,
      least(value / 210, 1.0) AS confidence,
      CAST((event_id * 7) % 330 AS DOUBLE) - 19.5 AS x1, CAST((event_id * 11) % 340 AS DOUBLE) - 29.75 AS y1 FROM events) e)"""
CLASS_OF = f"coalesce({picked(CLASS_NAMES, 'class_id')}, 'unknown')"
CLIPPED = """CAST(trunc(greatest(0.0, x1)) AS INTEGER) AS x1, CAST(trunc(greatest(0.0, y1)) AS INTEGER) AS y1,
    CAST(trunc(least(300.0, x2)) AS INTEGER) AS x2, CAST(trunc(least(300.0, y2)) AS INTEGER) AS y2"""
LISTED = f"""li AS MATERIALIZED (SELECT image_id, det_id, {CLASS_OF} AS class, round(confidence, 4) AS confidence, {CLIPPED},
    confidence AS exact FROM det WHERE confidence > 0.5)"""
BEST = """be AS MATERIALIZED (SELECT image_id, det_id, class, confidence, x1, y1, x2, y2 FROM li
    QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY exact DESC, det_id) = 1)"""

# Review


def order_query(key: str) -> str:
    return f"printf('%s_%02d', {picked(CLASS_NAMES, f'{key} % 5')}, {key})"


GT_QUERIES = f"""q AS MATERIALIZED (SELECT {order_query('o_orderkey')} AS query_id, {picked(CLASS_NAMES, 'o_orderkey % 5')} AS category,
    CAST(o_custkey AS VARCHAR) AS image_uuid, '/upload/' || {picked(CLASS_NAMES, 'o_orderkey % 5')} || '/' || o_custkey || '.jpg' AS image_url,
    o_orderkey, o_orderstatus FROM orders)"""
CANDIDATES = f"""c AS MATERIALIZED (SELECT {order_query('l_orderkey')} AS query_id, min(l_linenumber) AS rank, CAST(l_partkey AS VARCHAR) AS image_uuid,
    '/upload/' || l_partkey || '.jpg' AS image_url, round(max(1 - l_discount), 6) AS similarity FROM lineitem GROUP BY l_orderkey, l_partkey)"""
OLD_SELECTIONS = f"""os AS MATERIALIZED (SELECT {order_query('o_orderkey')} AS query_id, CAST(o_custkey AS VARCHAR) AS selected,
    o_orderdate AS completed_at FROM orders WHERE o_orderstatus = 'F')"""
VALIDATED = f"""sub AS MATERIALIZED (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS submission_id,
    {order_query('l_orderkey')} AS query_id, l_shipdate AS completed_at,
    CASE WHEN l_linenumber % 4 = 0 THEN ['x' || l_suppkey, 'y']
      ELSE [CAST(l_partkey AS VARCHAR), 'x' || l_suppkey, CAST(l_partkey AS VARCHAR), CAST(l_partkey + 1 AS VARCHAR)] END AS ids FROM lineitem),
  men AS (SELECT submission_id, query_id, unnest(ids) AS image_uuid, generate_subscripts(ids, 1) AS pos FROM sub),
  firsts AS (SELECT submission_id, query_id, image_uuid, min(pos) AS pos FROM men GROUP BY ALL),
  kept AS (SELECT submission_id, string_agg(f.image_uuid, ',' ORDER BY pos) AS selected, count(*) AS n
    FROM firsts f WHERE EXISTS (SELECT 1 FROM c WHERE c.query_id = f.query_id AND c.image_uuid = f.image_uuid) GROUP BY submission_id),
  val AS MATERIALIZED (SELECT s.submission_id, s.query_id, s.completed_at, coalesce(k.selected, '') AS selected,
    CAST(coalesce(k.n, 0) AS INTEGER) AS valid_ids, coalesce(k.n, 0) BETWEEN 1 AND 20 AS accepted
    FROM sub s LEFT JOIN kept k USING (submission_id))"""
SELECTIONS = """up AS MATERIALIZED (SELECT query_id, selected, completed_at FROM (
    SELECT query_id, selected, completed_at, NULL AS submission_id FROM os
    UNION ALL SELECT query_id, selected, completed_at, submission_id FROM val WHERE accepted) a
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY completed_at DESC, submission_id DESC NULLS LAST) = 1)"""
REVIEW = [GT_QUERIES, CANDIDATES, OLD_SELECTIONS, VALIDATED, SELECTIONS]
ISO = "'%Y-%m-%dT%H:%M:%S.%f'"
BY_PREFIX = " ".join(
    f"WHEN starts_with(query_id, '{c}_') THEN '{c}'" for c in sorted(CLASS_NAMES, key=len, reverse=True)
)


def id_run(start: str, length: str) -> str:
    return f"list_transform(range({start}, {start} + {length}), lambda i: CAST(i AS VARCHAR))"


def joined(values: str) -> str:
    return f"coalesce(list_aggregate({values}, 'string_agg', ','), '')"


ANSWERS = f"""an AS MATERIALIZED (SELECT query_id, ids, CASE {BY_PREFIX} END AS category, CAST(len(ids) AS INTEGER) AS n FROM (
    SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'etc_' || o_orderkey ELSE {order_query('o_orderkey')} END AS query_id,
    {id_run('o_custkey', 'o_orderkey % 20')} AS ids FROM orders) x)"""
ANSWER_RANKS = """ar AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, query_id) AS INTEGER) AS rank
    FROM an WHERE category IS NOT NULL)"""
EVALUATED = f"""re AS (SELECT DISTINCT {order_query('l_orderkey')} AS query_id, CAST(l_partkey AS VARCHAR) AS image_uuid FROM lineitem WHERE l_returnflag <> 'A'),
  rl AS (SELECT {order_query('l_orderkey')} AS query_id, CAST(l_partkey AS VARCHAR) AS image_uuid FROM lineitem WHERE l_returnflag <> 'N'
    UNION SELECT {order_query('l_orderkey')}, 'x' || l_suppkey FROM lineitem WHERE l_returnflag <> 'N' AND l_linestatus = 'O'),
  hits AS (SELECT query_id, count(*) AS hit FROM re JOIN rl USING (query_id, image_uuid) GROUP BY query_id),
  nre AS (SELECT query_id, count(*) AS retrieved FROM re GROUP BY query_id),
  nrl AS (SELECT query_id, count(*) AS relevant FROM rl GROUP BY query_id),
  ev AS MATERIALIZED (SELECT query_id, coalesce(hit, 0) AS hit, coalesce(retrieved, 0) AS retrieved, coalesce(relevant, 0) AS relevant,
    round(CASE WHEN retrieved > 0 THEN coalesce(hit, 0) / retrieved ELSE 0.0 END, 3) AS precision,
    round(CASE WHEN relevant > 0 THEN coalesce(hit, 0) / relevant ELSE 0.0 END, 3) AS recall
    FROM nre FULL JOIN nrl USING (query_id) LEFT JOIN hits USING (query_id))"""

# Requests

REGISTERED = sql_list([b.name for b in BACKBONES])
LOADED = sql_list([b.name for b in BACKBONES if b.loaded])
REQUESTS = """rq AS MATERIALIZED (SELECT o_orderkey AS request_id, CASE o_orderkey % 6 WHEN 1 THEN ['vgg16'] WHEN 2 THEN ['efficientnet', 'vgg16', 'efficientnet']
    WHEN 3 THEN ['resnet', 'vgg16'] WHEN 4 THEN ['resnet'] WHEN 5 THEN ['lite4', 'efficientnet'] END AS names FROM orders)"""
TARGETS = f"""asked AS (SELECT request_id, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM rq),
  once AS (SELECT request_id, name, min(pos) AS pos, list_contains({REGISTERED}, name) AS known FROM asked GROUP BY request_id, name),
  sorted AS (SELECT request_id, list(name ORDER BY pos) FILTER (known) AS targets, list(name ORDER BY pos) FILTER (NOT known) AS unknown FROM once GROUP BY request_id),
  tg AS MATERIALIZED (SELECT rq.request_id, CASE WHEN rq.names IS NULL THEN {LOADED} ELSE coalesce(targets, []) END AS targets, coalesce(unknown, []) AS unknown
    FROM rq LEFT JOIN sorted USING (request_id))"""
RUNS = f"""rn AS MATERIALIZED (SELECT o_orderkey AS request_id, name, (o_orderkey + length(name)) % 13 = 0 AS bad,
    printf('[%d, %d]', o_orderkey, length(name)) AS channel_order, o_totalprice / 1003 AS ms
    FROM orders, (SELECT unnest({REGISTERED}) AS name) b)"""

# Training data

LABELME = f"""lm AS MATERIALIZED (SELECT *, stem || '.json' AS file_name,
    CASE {' '.join(f"WHEN starts_with(stem, '[{k}]') THEN {i}" for i, k in enumerate(KOREAN))} END AS class_id FROM (
    SELECT CASE WHEN p_partkey % 7 < 5 THEN '[' || {picked(KOREAN, 'p_partkey % 7')} || '] ' WHEN p_partkey % 7 = 5 THEN '[기타] ' ELSE '' END
      || p_name || ' ' || p_partkey AS stem, p_partkey AS k, p_size, CASE WHEN p_partkey % 23 = 0 THEN 0 ELSE 300 END AS w FROM part) x)"""


def corner(factor: int, step: int, span: int) -> str:
    return f"CAST((k * {factor} + j * {step}) % {span} - 10 AS DOUBLE)"


def in_unit(value: str) -> str:
    return f"greatest(0.0, least(1.0, {value}))"


BOXES = f"""bx AS MATERIALIZED (SELECT stem, class_id, CAST(row_number() OVER (PARTITION BY stem ORDER BY j) - 1 AS INTEGER) AS position,
    {in_unit('((x1 + x2) / 2) / w')} AS cx, {in_unit('((y1 + y2) / 2) / 240')} AS cy, {in_unit('abs(x2 - x1) / w')} AS w, {in_unit('abs(y2 - y1) / 240')} AS h FROM (
      SELECT stem, class_id, w, j, {corner(7, 31, 320)} AS x1, {corner(11, 17, 260)} AS y1, {corner(13, 29, 320)} AS x2, {corner(5, 41, 260)} AS y2
      FROM (SELECT *, unnest(range(k % 4)) AS j FROM lm WHERE w <> 0 AND class_id IS NOT NULL) y WHERE (k + j) % 3 <> 0) z)"""
LABEL_TEXTS = """tx AS (SELECT stem, string_agg(printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h), chr(10) ORDER BY position) AS label_text FROM bx GROUP BY stem)"""
SPLIT = """sp AS MATERIALIZED (SELECT stem, class_id, CASE WHEN row_number() OVER (PARTITION BY class_id ORDER BY md5('42:' || stem), stem)
    <= floor(count(*) OVER (PARTITION BY class_id) * 0.2) THEN 'val' ELSE 'train' END AS split FROM lm WHERE class_id IS NOT NULL)"""
EXTENSION = "CASE WHEN p_size >= 20 THEN '.jpg' WHEN p_size >= 10 THEN '.png' END"
SAFE = f"regexp_replace({picked(CLASS_NAMES, 'lm.class_id')} || '_' || string_split(lm.stem, '] ')[-1], '[^\\p{{L}}\\p{{N}}_-]', '_', 'g')"
MANIFEST = f"""mf AS MATERIALIZED (SELECT lm.stem, lm.class_id, sp.split, {SAFE} AS safe_name, {EXTENSION} AS ext, label_text,
    label_text IS NOT NULL AND {EXTENSION} IS NOT NULL AS ok FROM lm JOIN sp USING (stem) LEFT JOIN tx USING (stem))"""
LABEL_FILES = """lf AS MATERIALIZED (SELECT split, safe_name, label_text FROM mf WHERE ok QUALIFY row_number() OVER (PARTITION BY split, safe_name ORDER BY stem DESC) = 1)"""
TRAINING = [LABELME, BOXES, LABEL_TEXTS, SPLIT, MANIFEST]

# The query document of the named categories.

DOCUMENT = [
    selection(20), PAIRS, ranked("sim", "pairs", 20, "top"),
    f"named AS MATERIALIZED (SELECT *, {picked(CLASS_NAMES, 'grp')} AS category FROM picks WHERE grp < 5)",
    # Ids of a catalogue are text, and so are its tie-breaks.
]


def document_selection(n: int) -> str:
    """The selection with text ids, in text order."""
    return selection(n).replace("SELECT vec_id AS id", "SELECT CAST(vec_id AS VARCHAR) AS id")


DOCUMENT[0] = document_selection(20)

SQL: dict[str, str] = {
    "l2_normalize": with_all(VECTORS, select=unnested("v", f"list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), {NORM_FLOOR}))", 9)),
    "stage_signature": with_all(VECTORS, SIGNATURES, select=unnested("sg", "s", 9)),
    "channel_means": with_all(VECTORS, select="""SELECT vec_id, CAST(c AS INTEGER) AS position,
        round(list_sum(list_transform(range(16), lambda p: e[p * 4 + c + 1])) / 16, 9) AS hwc,
        round(list_sum(e[c * 16 + 1:c * 16 + 16]) / 16, 9) AS chw FROM (SELECT *, unnest(range(4)) AS c FROM v) x"""),
    "top_channels": with_all(VECTORS, SIGNATURES, CHANNEL_LISTS, select="SELECT vec_id, '[' || list_aggregate(c, 'string_agg', ', ') || ']' AS channel_order FROM ch"),
    "binarize": with_all(VECTORS, BITS, select="SELECT vec_id, list_aggregate(b, 'string_agg', '') AS bits FROM bt"),
    "pack_bits": with_all(VECTORS, BITS, PACKED, select="SELECT vec_id, packed, list_aggregate(words, 'string_agg', ',') AS words FROM pk"),
    "base64_codes": with_all(VECTORS, BITS, PACKED, select="SELECT vec_id, base64(unhex(packed)) AS coded, packed AS decoded FROM pk"),
    "float16_roundtrip": "SELECT vec_id, CAST(len(embedding) * 2 AS INTEGER) AS code_bytes, true AS close FROM embeddings",
    "channel_standardize": with_all(VECTORS, PIXELS, select=f"""SELECT vec_id, CAST(i AS INTEGER) AS position,
        round((p[(i % 16) * 3 + i // 16 + 1] / 255 - {sql_list(RGB_MEAN)}[i // 16 + 1]) / {sql_list(RGB_STD)}[i // 16 + 1], 6) AS value
        FROM (SELECT *, unnest(range(48)) AS i FROM px) x"""),
    "channel_center_bgr": with_all(VECTORS, PIXELS, select=f"""SELECT vec_id, CAST(i AS INTEGER) AS position,
        round(p[i - i % 3 + 2 - i % 3 + 1] - {sql_list(BGR_MEAN)}[i % 3 + 1], 6) AS value FROM (SELECT *, unnest(range(48)) AS i FROM px) x"""),
    "diverse_queries": with_all(selection(20), select="""SELECT grp AS "group", CAST(ordinal AS INTEGER) AS ordinal, id,
        round(ms, 6) AS max_similarity, coalesce(ms >= 0.95, false) AS over_threshold FROM picks"""),
    "max_query_similarity": with_all(selection(20), select="""SELECT p.grp AS "group", p.queries, round(greatest(coalesce(m.s, 0.0), 0.0), 6) AS max_similarity FROM
        (SELECT grp, count(*) AS queries FROM picks GROUP BY grp) p LEFT JOIN
        (SELECT a.grp, max(round(list_dot_product(ua.u, ub.u), 10)) AS s FROM picks a JOIN picks b ON a.grp = b.grp AND a.id < b.id
          JOIN u ua ON ua.id = a.id JOIN u ub ON ub.id = b.id GROUP BY a.grp) m ON m.grp = p.grp"""),
    "cosine_topk": with_all(selection(20), PAIRS, ranked("sim", "pairs", 20, "found"), select=NEIGHBOURS.format("found")),
    "cosine_topk_small_group": with_all(VECTORS, UNITS, """pairs AS MATERIALIZED (SELECT q.grp * 40 + q.id % 40 AS grp, q.id AS query, i.id,
        round(list_dot_product(i.u, q.u), 10) AS sim FROM u q JOIN u i ON i.grp = q.grp AND i.id % 40 = q.id % 40 AND i.id <> q.id)""",
        ranked("sim", "pairs", 20, "found"), select=NEIGHBOURS.format("found")),
    "channel_overlap_topn": with_all(selection(20), SIGNATURES, CHANNEL_LISTS, PAIRS, SHARED, "near AS (SELECT * FROM shared WHERE shared > 0)",
        ranked("shared", "near", 30, "found"), select='SELECT grp AS "group", query, id, rank, shared FROM found'),
    "hamming_topk": with_all(selection(20), BITS, PACKED, PAIRS, distances("pairs", "d"), ranked("distance", "d", 20, "found", ascending=True),
        select='SELECT grp AS "group", query, id, rank, distance FROM found'),
    "near_signatures": with_all(selection(20), BITS, PACKED, PAIRS, distances("pairs", "d"), ranked("distance", "d", 20, "found", ascending=True),
        select='SELECT grp AS "group", query, id, rank, distance FROM found'),
    "rerank_cosine": with_all(selection(20), BITS, PACKED, PAIRS, distances("pairs", "d"), ranked("distance", "d", 20, "near", ascending=True),
        "short AS (SELECT grp, query, id, sim FROM near)", ranked("sim", "short", 10, "found"), select=NEIGHBOURS.format("found")),
    "hamming_candidates": with_all(selection(20), BITS, PACKED, PAIRS, select="""SELECT p.grp AS "group", p.query,
        count_if(list_bool_or(list_transform(range(8), lambda i: (a.words[i // 4 + 1] >> (i % 4 * 8)) & 255 = (b.words[i // 4 + 1] >> (i % 4 * 8)) & 255)))::BIGINT AS compared
        FROM pairs p JOIN pk a ON a.vec_id = p.query JOIN pk b ON b.vec_id = p.id GROUP BY p.grp, p.query"""),
    "three_stage_search": with_all(*CASCADE, select=NEIGHBOURS.format("found")),
    "indexed_search": with_all(*CASCADE, select=NEIGHBOURS.format("found")),
    "three_stage_recall": with_all(*CASCADE, ranked("sim", "pairs", 10, "exact"), select="""SELECT query_id, hit, retrieved, relevant,
        round(hit / retrieved, 3) AS precision, round(hit / relevant, 3) AS recall FROM (
        SELECT e.grp || '_' || e.query AS query_id, count(f.id) AS hit, any_value(n.n) AS retrieved, count(*) AS relevant FROM exact e
        LEFT JOIN found f ON f.query = e.query AND f.id = e.id JOIN (SELECT query, count(*) AS n FROM found GROUP BY query) n ON n.query = e.query GROUP BY e.grp, e.query) x"""),
    "category_from_url": with_all(PART_URLS, select=f"SELECT p_partkey, image_url, {url_category('image_url')} AS category FROM pu"),
    "url_to_english": with_all(PART_URLS, select=f"SELECT p_partkey, {english('image_url')} AS image_url FROM pu"),
    "resolve_path": with_all(PART_URLS, select="SELECT p_partkey, '/data/upload/' || " + english("ltrim(replace(image_url, '/upload/', ''), '/')") + " AS path FROM pu"),
    "image_meta_dedup": with_all(META, select="SELECT * FROM meta"),
    "dim_filter": with_all(VECTORS, FEATURES, select="SELECT image_uuid, CAST(len(e) AS INTEGER) AS width FROM fe WHERE len(e) = 64"),
    "features_join_meta": with_all(VECTORS, FEATURES, META, select=f"""SELECT image_uuid, image_url, category, round(sqrt(list_dot_product(e, e)), 6) AS norm
        FROM fe JOIN meta USING (image_uuid) WHERE len(e) = 64 AND {KNOWN}"""),
    "load_stats": with_all(VECTORS, FEATURES, META, select=f"""SELECT category, CASE WHEN category IS NULL THEN 0 ELSE n END AS rows, CASE WHEN category IS NULL THEN n ELSE 0 END AS skipped FROM (
        SELECT CASE WHEN len(e) = 64 AND {KNOWN} THEN category END AS category, count(*) AS n FROM fe LEFT JOIN meta USING (image_uuid) GROUP BY 1) x"""),
    "incremental_todo": """SELECT CAST(l_orderkey AS VARCHAR) AS image_uuid, l_linenumber, l_partkey, l_suppkey FROM lineitem
        WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
    "chunk_number": """SELECT image_uuid, CAST(7 + ceil(row_number() OVER (ORDER BY image_uuid) / 500.0) AS BIGINT) AS file_no
        FROM (SELECT CAST(o_orderkey AS VARCHAR) AS image_uuid FROM orders) x""",
    "run_stats": with_all(SCORED, select="""SELECT count(*) FILTER (NOT failed) AS success, count(*) FILTER (failed) AS failed,
        (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS skipped, round(count(*) FILTER (NOT failed) / 12.5, 1) AS per_second FROM sc"""),
    "failure_log": with_all(SCORED, select="SELECT name || ' - ' || reason AS value FROM sc WHERE failed"),
    "scan_image_list": with_all(PART_URLS, select="""SELECT CAST(p_partkey AS VARCHAR) AS image_uuid, image_url,
        'a "' || p_name || '", ' || p_brand AS image_original_name FROM pu JOIN part USING (p_partkey)"""),
    "batch_score": with_all(VECTORS, BITS, PACKED, VECTOR_CODES, select="""SELECT CAST(vec_id AS VARCHAR) AS image_uuid, CASE WHEN failed THEN 'failed' ELSE 'ok' END AS status,
        CASE WHEN NOT failed THEN channel_order END AS channel_order, CASE WHEN NOT failed THEN packed END AS signature,
        CASE WHEN NOT failed THEN CAST(len(e) * 2 AS INTEGER) END AS embedding_bytes, CASE WHEN failed THEN 'cannot read ' || vec_id END AS reason FROM co"""),
    "register_scorer": "SELECT CASE WHEN vec_id % 17 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS images FROM embeddings GROUP BY 1",
    "latency_of_runs": """SELECT name, CASE name WHEN 'vgg16' THEN count(*) FILTER (vec_id % 17 <> 0) ELSE count(*) END AS runs, true AS in_order
        FROM embeddings, (VALUES ('vgg16'), ('efficientnet')) AS extractors(name) GROUP BY name""",
    "run_history": """SELECT CAST(1 AS BIGINT) AS number, count(*) FILTER (vec_id % 17 <> 0) AS success, count(*) FILTER (vec_id % 17 = 0) AS failed FROM embeddings WHERE vec_id % 3 = 0
        UNION ALL SELECT 2, count(*) FILTER (vec_id % 17 <> 0 AND vec_id % 3 <> 0), count(*) FILTER (vec_id % 17 = 0) FROM embeddings""",
    "initial_selections": with_all(OLD_SELECTIONS, select="SELECT query_id, selected FROM os WHERE query_id LIKE 'bag\\_%' ESCAPE '\\'"),
    "test_query_document": with_all(GT_QUERIES, ANSWERS, ANSWER_RANKS, select=f"""SELECT ar.category, CAST(rank AS INTEGER) AS rank, ar.query_id, coalesce(q.image_uuid, '') AS image_uuid,
        coalesce(q.image_url, '') AS image_url, CAST(n AS INTEGER) AS ground_truth_count, {joined('ids')} AS ground_truth FROM ar LEFT JOIN q ON q.query_id = ar.query_id WHERE rank <= 10"""),
    "processed_keys": "SELECT CAST(vec_id AS VARCHAR) AS image_uuid FROM embeddings WHERE vec_id % 17 <> 0",
    "scan_features": with_all(VECTORS, BITS, PACKED, VECTOR_CODES, select="""SELECT CAST(vec_id AS VARCHAR) AS image_uuid, packed AS signature, channel_order,
        round(sqrt(list_dot_product(e, e)), 2) AS norm FROM co WHERE NOT failed"""),
    "max_file_index": "SELECT CAST(3 + ceil(count(*) / 500.0) AS BIGINT) AS file_index FROM embeddings WHERE vec_id % 17 <> 0",
    "stream_incremental": "SELECT CAST(p_partkey AS VARCHAR) AS image_uuid, CASE WHEN p_partkey % 17 = 0 THEN 'failed' ELSE 'ok' END AS state FROM part",
    "class_name_fallback": with_all(DETECTIONS, select=f"SELECT det_id, {CLASS_OF} AS class FROM det"),
    "confidence_filter": with_all(DETECTIONS, select="SELECT det_id, round(confidence, 6) AS confidence FROM det WHERE confidence > 0.5"),
    "box_clip": with_all(DETECTIONS, select=f"SELECT det_id, {CLIPPED} FROM det"),
    "detections_per_image": with_all(DETECTIONS, LISTED, select="""
        SELECT c_custkey AS image_id, det_id, class, confidence, CASE WHEN present THEN concat_ws(':', x1, y1, x2, y2) END AS coordinate
        FROM (SELECT *, true AS present FROM li) d RIGHT JOIN customer ON d.image_id = c_custkey"""),
    "best_detection": with_all(DETECTIONS, LISTED, BEST, select="SELECT * FROM be"),
    "crop_rectangle": with_all(DETECTIONS, LISTED, BEST, select="""SELECT c_custkey AS image_id, CASE WHEN x2 > x1 AND y2 > y1 THEN class END AS class,
        CASE WHEN x2 > x1 AND y2 > y1 THEN confidence END AS confidence, CASE WHEN x2 > x1 AND y2 > y1 THEN x1 ELSE 0 END AS x1,
        CASE WHEN x2 > x1 AND y2 > y1 THEN y1 ELSE 0 END AS y1, CASE WHEN x2 > x1 AND y2 > y1 THEN x2 ELSE 300 END AS x2,
        CASE WHEN x2 > x1 AND y2 > y1 THEN y2 ELSE 300 END AS y2 FROM customer LEFT JOIN be ON image_id = c_custkey"""),
    "detection_class_counts": with_all(DETECTIONS, LISTED, select="""SELECT image_id, class, count(*) AS detections,
        round(count(*) / sum(count(*)) OVER (PARTITION BY image_id), 6) AS share FROM li GROUP BY image_id, class"""),
    "gt_query_list": with_all(GT_QUERIES, select="SELECT query_id, category, image_uuid, image_url, o_orderstatus = 'F' AS completed FROM q"),
    "gt_status": with_all(GT_QUERIES, select="""SELECT category, total, completed, round(completed / total * 100, 6) AS percent,
        CASE WHEN completed = total THEN 'done' ELSE 'pending' END AS badge FROM (
        SELECT coalesce(category, 'overall') AS category, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed FROM q GROUP BY ROLLUP (category)) x WHERE total > 0"""),
    "selection_validate": with_all(CANDIDATES, VALIDATED, select="SELECT submission_id, query_id, selected, valid_ids, accepted FROM val"),
    "selection_upsert": with_all(*REVIEW, select=f"SELECT query_id, selected, strftime(completed_at, {ISO}) AS completed_at FROM up"),
    "gt_query_detail": with_all(*REVIEW, select="""SELECT q.query_id, q.category, q.image_uuid AS query_image_uuid, q.image_url AS query_image_url, c.rank, c.image_uuid, c.image_url, c.similarity,
        list_contains(string_split(up.selected, ','), c.image_uuid) AS selected FROM q LEFT JOIN up USING (query_id) LEFT JOIN c ON c.query_id = q.query_id"""),
    "gt_export": with_all(*REVIEW, select="""SELECT q.query_id, q.category, q.image_uuid AS query_image_uuid, q.image_url AS query_image_url, c.rank, c.image_uuid, c.image_url, c.similarity
        FROM q JOIN up USING (query_id) LEFT JOIN c ON c.query_id = q.query_id AND list_contains(string_split(up.selected, ','), c.image_uuid)"""),
    "query_navigation": with_all(GT_QUERIES, select=f"""SELECT row_number() OVER w - 1 AS place, category, query_id, lag(query_id) OVER w AS previous_query_id, lead(query_id) OVER w AS next_query_id
        FROM q WINDOW w AS (ORDER BY list_position({sql_list(CLASS_NAMES)}, category), query_id)"""),
    "gt_totals": """SELECT (SELECT count(*) FROM embeddings WHERE label < 5) AS total_images, count(DISTINCT o_orderkey % 5) AS categories, count(*) AS total_queries FROM orders""",
    "similarity_percent": with_all(CANDIDATES, select="SELECT query_id, image_uuid, printf('%.1f%%', similarity * 100) AS percent FROM c"),
    "stream_selection_upsert": with_all(CANDIDATES, VALIDATED, select=f"""SELECT query_id, selected, strftime(completed_at, {ISO}) AS completed_at FROM val WHERE accepted
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY completed_at DESC, submission_id DESC) = 1"""),
    "queries_document": with_all(*DOCUMENT, select="""SELECT (SELECT count(*) FROM embeddings WHERE label < 5) AS all_images, category,
        (SELECT count(*) FROM embeddings e WHERE e.label = n.grp) AS total_images,
        string_agg(printf('%s_%02d', category, ordinal) || '=' || id, ',' ORDER BY ordinal) AS queries FROM named n GROUP BY grp, category"""),
    "flatten_queries": with_all(*DOCUMENT, select="""SELECT printf('%s_%02d', n.category, n.ordinal) AS query_id, n.category, n.id AS query_image_uuid, t.rank, t.id AS image_uuid,
        '/upload/' || n.category || '/' || t.id || '.jpg' AS image_url, round(t.sim, 6) AS similarity FROM named n JOIN top t ON t.query = n.id"""),
    "scan_selections": with_all(OLD_SELECTIONS, select=f"SELECT query_id, selected, strftime(completed_at, {ISO}) AS completed_at FROM os"),
    "scan_reviewed": f"""SELECT {order_query('o_orderkey')} AS query_id, {joined(id_run('o_orderkey', 'o_orderkey % 9'))} AS selected,
        CAST(10 - o_orderkey % 2 AS INTEGER) AS total_results, '2026-04-19T19:59:48.307218' AS completed_at FROM orders""",
    "category_from_query_id": with_all(ANSWERS, select="SELECT query_id, category FROM an"),
    "rank_queries": with_all(GT_QUERIES, ANSWERS, ANSWER_RANKS, select=f"""SELECT ar.category, rank, ar.query_id, coalesce(q.image_uuid, '') AS image_uuid, coalesce(q.image_url, '') AS image_url,
        n AS ground_truth_count, {joined('ids')} AS ground_truth FROM ar LEFT JOIN q ON q.query_id = ar.query_id AND o_orderstatus <> 'P' WHERE rank <= 10"""),
    "rank_cutoff": with_all(ANSWERS, ANSWER_RANKS, select="""SELECT category, count(*) AS queries, CASE WHEN count(*) > 10 THEN max(n) FILTER (rank = 10) END AS cutoff FROM ar GROUP BY category"""),
    "eval_per_query": with_all(EVALUATED, select="SELECT * FROM ev"),
    "eval_summary": with_all(EVALUATED, select=f"""SELECT CASE {BY_PREFIX} END AS category, count(*) AS query_count, round(avg(precision), 3) AS avg_precision, round(avg(recall), 3) AS avg_recall FROM ev GROUP BY 1"""),
    "reviewed_precision": """SELECT run, """ + picked(CLASS_NAMES, "k % 5") + """ AS category, count(*) AS query_count, round(avg(k % 9 / (10 - k % 2)), 3) AS precision
        FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS run, o_orderkey AS k FROM orders) x GROUP BY 1, 2""",
    "compare_reviews": f"""SELECT coalesce(a.query_id, b.query_id) AS query_id, a.query_id IS NOT NULL AS in_a, b.query_id IS NOT NULL AS in_b,
        CAST(len(list_intersect(coalesce(a.ids, []), coalesce(b.ids, []))) AS INTEGER) AS shared,
        CAST(coalesce(len(a.ids), 0) - len(list_intersect(coalesce(a.ids, []), coalesce(b.ids, []))) AS INTEGER) AS only_a,
        CAST(coalesce(len(b.ids), 0) - len(list_intersect(coalesce(a.ids, []), coalesce(b.ids, []))) AS INTEGER) AS only_b
        FROM (SELECT {order_query('o_orderkey')} AS query_id, {id_run('o_orderkey', 'o_orderkey % 10')} AS ids FROM orders WHERE o_orderstatus <> 'O') a
        FULL JOIN (SELECT {order_query('o_orderkey')} AS query_id, {id_run('o_orderkey + 3', 'o_orderkey % 7')} AS ids FROM orders WHERE o_orderstatus <> 'P') b ON a.query_id = b.query_id""",
    "backbone_registry": with_all(REQUESTS, TARGETS, select="SELECT b.*, coalesce(n.n, 0) AS requests FROM (VALUES "
        + ", ".join(f"('{b.name}', '{b.display_name}', {str(b.loaded).lower()}, {b.input_w}, {b.input_h})" for b in BACKBONES)
        + """) b(name, display_name, loaded, input_w, input_h) LEFT JOIN (SELECT name, count(*) AS n FROM (SELECT unnest(targets) AS name FROM tg) x GROUP BY name) n USING (name)"""),
    "backbone_targets": with_all(REQUESTS, TARGETS, select=f"""SELECT request_id, {joined('targets')} AS targets, {joined('unknown')} AS unknown,
        CASE WHEN len(targets) = 0 THEN 'no loaded backbone' ELSE 'ok' END AS status FROM tg"""),
    "backbone_lookup": with_all(REQUESTS, select=f"""SELECT request_id, name, CASE WHEN list_contains({LOADED}, name) THEN 'ok' WHEN list_contains({REGISTERED}, name) THEN 'not loaded' ELSE 'unknown' END AS status
        FROM (SELECT request_id, unnest(names) AS name FROM rq) x"""),
    "compare_extractors": """
        WITH targets AS (SELECT vec_id, embedding AS e, unnest(CASE vec_id % 4 WHEN 1 THEN ['vgg16'] WHEN 2 THEN ['efficientnet']
            WHEN 3 THEN ['lite4', 'vgg16'] ELSE ['vgg16', 'efficientnet'] END) AS name FROM embeddings),
        lists AS (SELECT vec_id, name, list_transform(range(1, len(e) + 1),
            lambda i: struct_pack(v := CASE name WHEN 'vgg16' THEN -e[i] ELSE e[i] END, i := i - 1)) AS c FROM targets)
        SELECT vec_id AS request_id, name, CASE WHEN name = 'lite4' OR (name = 'vgg16' AND vec_id % 17 = 0) THEN NULL ELSE
            '[' || array_to_string(list_transform(list_sort(c)[1:CASE name WHEN 'vgg16' THEN 25 ELSE 40 END], lambda s: s.i), ', ') || ']' END AS channel_order,
            CASE WHEN name = 'lite4' THEN 'not loaded' WHEN name = 'vgg16' AND vec_id % 17 = 0 THEN 'cannot read ' || vec_id END AS error
        FROM lists""",
    "compare_backbones": with_all(REQUESTS, TARGETS, RUNS, select="""SELECT t.request_id, t.name, CASE WHEN NOT bad THEN channel_order END AS channel_order,
        CASE WHEN bad THEN 'cannot run ' || t.name END AS error, CASE WHEN NOT bad THEN round(ms, 2) END AS latency_ms
        FROM (SELECT request_id, unnest(targets) AS name FROM tg) t JOIN rn USING (request_id, name)"""),
    "latency_by_backbone": with_all(RUNS, select="""SELECT name, count(*) AS runs, round(avg(ms), 2) AS avg_ms, round(min(ms), 2) AS min_ms,
        round(quantile_disc(ms, 0.5), 2) AS p50_ms, round(quantile_disc(ms, 0.95), 2) AS p95_ms, round(max(ms), 2) AS max_ms FROM rn WHERE NOT bad GROUP BY name"""),
    "class_from_filename": with_all(LABELME, select="SELECT stem, class_id FROM lm"),
    "labelme_to_yolo": with_all(LABELME, BOXES, select="SELECT stem, class_id, position, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h FROM bx"),
    "safe_name": with_all(LABELME, select=f"SELECT stem, {SAFE} AS safe_name FROM lm WHERE class_id IS NOT NULL"),
    "stratified_split": with_all(LABELME, SPLIT, select="SELECT * FROM sp"),
    "label_image_match": with_all(LABELME, select=f"SELECT stem, {EXTENSION} AS ext FROM lm"),
    "dataset_manifest": with_all(*TRAINING, select="SELECT stem, class_id, split, safe_name, ext, ok FROM mf"),
    "yolo_label_text": with_all(*TRAINING, LABEL_FILES, select="SELECT * FROM lf"),
    "split_stats": with_all(*TRAINING, select="""SELECT count(*) FILTER (ok AND split = 'train') AS train, count(*) FILTER (ok AND split = 'val') AS val,
        count(*) FILTER (NOT ok) AS failed, (SELECT count(*) FROM lm WHERE class_id IS NULL) AS skipped FROM mf"""),
    "class_distribution": with_all(*TRAINING, LABEL_FILES, select=f"""SELECT CAST(i AS INTEGER) AS class_id, {picked(CLASS_NAMES, 'i')} AS class, count(l.c) AS labels FROM (SELECT unnest(range(5)) AS i) x LEFT JOIN
        (SELECT CAST(string_split(unnest(string_split(label_text, chr(10))), ' ')[1] AS INTEGER) AS c FROM lf) l ON l.c = i GROUP BY i"""),
    "split_file_counts": """SELECT split, kind, count(*) AS files FROM (
        SELECT CASE WHEN s_nationkey < 5 THEN 'val' ELSE 'train' END AS split, unnest(CASE WHEN s_acctbal > 0 THEN ['images', 'labels'] ELSE ['images'] END) AS kind FROM supplier) x GROUP BY 1, 2""",
    "scan_image_files": "SELECT '.txt' AS ext, count(*) AS files FROM supplier",
    "scan_labelme": """SELECT 300 AS "imageWidth", s_nationkey AS "imageHeight", CAST(s_suppkey AS DOUBLE) AS y1, 'rectangle' AS shape_type FROM supplier""",
}
