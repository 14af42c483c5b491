"""DuckDB twins of the registered queries (the correctness oracle).

Each SQL text is self-contained: it re-derives the views of FIXTURES.md section 3 as
common table expressions over the pre-registered driver tables, written independently
of the Spark code (windows and band joins where Spark uses bucketed offsets).
"""

from __future__ import annotations

# ---------------------------------------------------------------- derived views
_U = "CAST(('0x' || substr(md5({seed} || ':' || {draw} || ':' || CAST({unit} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0"


def u_sql(seed: str, draw: str, unit: str) -> str:
    return _U.format(seed=seed, draw=draw, unit=unit)


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ocr_train": (
        (),
        """SELECT p_partkey AS row_id,
       './train/TRAIN_' || CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 5 THEN lpad(CAST(p_partkey AS VARCHAR), 5, '0') ELSE CAST(p_partkey AS VARCHAR) END || '.png' AS img_path,
       array_to_string(list_transform(range(1, 2 + p_partkey % 6),
           lambda i: chr(CAST(44032 + (p_partkey * 7919 + i * 104729) % 11172 AS INTEGER))), '') AS label
FROM part""",
    ),
    "ocr_names": (
        (),
        """SELECT p_partkey AS row_id,
       './train/TRAIN_' || CASE WHEN length(CAST(p_partkey AS VARCHAR)) < 5 THEN lpad(CAST(p_partkey AS VARCHAR), 5, '0') ELSE CAST(p_partkey AS VARCHAR) END || '.png' AS img_path,
       p_name AS label
FROM part""",
    ),
    "ocr_words": (
        (),
        """SELECT doc_id * 2147483648 + w.pos - 1 AS row_id,
       './train/TRAIN_' || CASE WHEN length(CAST((doc_id * 2147483648 + w.pos - 1) AS VARCHAR)) < 5 THEN lpad(CAST((doc_id * 2147483648 + w.pos - 1) AS VARCHAR), 5, '0') ELSE CAST((doc_id * 2147483648 + w.pos - 1) AS VARCHAR) END || '.png' AS img_path,
       w.word AS label
FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word,
             unnest(range(1, len(string_split(text, ' ')) + 1)) AS pos FROM documents) w""",
    ),
    "ocr_test": (("ocr_train",), "SELECT row_id, img_path FROM ocr_train"),
    "ocr_raw_pred": (
        ("ocr_train",),
        f"""SELECT row_id, CAST(fold AS INTEGER) AS fold,
       CASE WHEN u < 0.2 THEN substr(label, 1, 1) || 'ㄴ ' || substr(label, 2)
            WHEN u < 0.35 THEN substr(label, 1, length(label) - 1)
            ELSE label END AS raw_text,
       -3 * u AS seq_score
FROM (SELECT t.row_id, t.label, f.fold, {u_sql("'42'", "'pred' || CAST(f.fold AS VARCHAR)", "t.row_id")} AS u
      FROM ocr_train t, range(0, 5) f(fold)) x""",
    ),
    "ocr_beams": (
        ("ocr_raw_pred",),
        """SELECT row_id, fold, CAST(b.beam AS INTEGER) AS beam,
       CASE WHEN b.beam = 0 THEN raw_text ELSE raw_text || chr(CAST(44031 + b.beam AS INTEGER)) END AS raw_text,
       seq_score - 0.25 * b.beam AS seq_score
FROM ocr_raw_pred, range(0, 5) b(beam)""",
    ),
    "char_vocab": (
        (),
        """SELECT token, CAST(id AS BIGINT) AS id FROM (
  SELECT '[PAD]' AS token, 0 AS id UNION ALL SELECT '[UNK]', 1
  UNION ALL
  SELECT token, 1 + row_number() OVER (ORDER BY token) FROM (
    SELECT DISTINCT unnest(string_split(text, '')) AS token FROM benchmark) c
  WHERE token <> '')""",
    ),
    "logits": (
        (),
        """SELECT CAST(label AS BIGINT) AS row_id, vec_id AS fold, 0 AS step,
       CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS token_id,
       CAST(unnest(embedding) AS DOUBLE) AS logit
FROM embeddings""",
    ),
    "step_log": (
        (),
        """SELECT CAST(user_id % 5 AS INTEGER) AS fold, event_id AS step, value AS loss,
       CAST(1 + event_id % 64 AS INTEGER) AS n FROM events""",
    ),
    # W1 on ocr_train long labels: windows + a band join on per-stratum quota ranges.
    "ocr_folds": (
        ("ocr_train",),
        """SELECT r.row_id, r.img_path, r.label, r.length, CAST(q.f AS INTEGER) AS fold
FROM (SELECT row_id, replace(img_path, './', './data/') AS img_path, label, CAST(length(label) AS INTEGER) AS length,
             row_number() OVER (PARTITION BY length(label) ORDER BY row_id) - 1 AS rn
      FROM ocr_train WHERE length(label) > 1) r
JOIN (SELECT length, f, sum(a) OVER (PARTITION BY length ORDER BY f) - a AS lo, sum(a) OVER (PARTITION BY length ORDER BY f) AS hi
      FROM (SELECT length, f, floor((s + c - 1 - f) / 5.0) - floor((s - 1 - f) / 5.0) AS a
            FROM (SELECT length, c, coalesce(sum(c) OVER (ORDER BY first, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
                  FROM (SELECT length(label) AS length, count(*) AS c, min(row_id) AS first FROM ocr_train WHERE length(label) > 1 GROUP BY 1) s0) s1,
                 range(0, 5) t(f)) q0) q
  ON r.length = q.length AND r.rn >= q.lo AND r.rn < q.hi""",
    ),
    # fold table: long rows with fold, short rows with null fold
    "ocr_fold_table": (
        ("ocr_folds", "ocr_train"),
        """SELECT row_id, img_path, label, length, fold FROM ocr_folds
UNION ALL
SELECT row_id, replace(img_path, './', './data/'), label, CAST(length(label) AS INTEGER), CAST(NULL AS INTEGER)
FROM ocr_train WHERE length(label) = 1""",
    ),
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` and their dependencies."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n][1]}\n)" for n in order)
    return f"WITH {ctes}\n{body}"


# ---------------------------------------------------------------- oracle queries
SQL: dict[str, str] = {}

SQL["fold_sizes"] = with_views(
    """SELECT CAST(k.k AS INTEGER) AS fold, t.length,
       CAST(sum(CASE WHEN t.fold = k.k THEN 0 ELSE 1 END) AS BIGINT) AS train_rows,
       CAST(sum(CASE WHEN t.fold = k.k THEN 1 ELSE 0 END) AS BIGINT) AS valid_rows
FROM ocr_fold_table t, range(0, 5) k(k)
GROUP BY 1, 2""",
    "ocr_fold_table",
)


def _folds_view(order: str, source: str = "ocr_train") -> str:
    """W1 restated: row_number per stratum + quota ranges per (stratum, fold)."""
    return f"""SELECT r.row_id, r.img_path, r.label, r.length, CAST(q.f AS INTEGER) AS fold
FROM (SELECT row_id, replace(img_path, './', './data/') AS img_path, label, CAST(length(label) AS INTEGER) AS length,
             row_number() OVER (PARTITION BY length(label) ORDER BY {order}) - 1 AS rn
      FROM {source} WHERE length(label) > 1) r
JOIN (SELECT length, f, sum(a) OVER (PARTITION BY length ORDER BY f) - a AS lo, sum(a) OVER (PARTITION BY length ORDER BY f) AS hi
      FROM (SELECT length, f, floor((s + c - 1 - f) / 5.0) - floor((s - 1 - f) / 5.0) AS a
            FROM (SELECT length, c, coalesce(sum(c) OVER (ORDER BY first, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
                  FROM (SELECT length(label) AS length, count(*) AS c, min(row_id) AS first FROM {source} WHERE length(label) > 1 GROUP BY 1) s0) s1,
                 range(0, 5) t(f)) q0) q
  ON r.length = q.length AND r.rn >= q.lo AND r.rn < q.hi"""


# NFKD of Hangul syllables by Unicode arithmetic (DuckDB has no NFKD).
def nfkd_sql(col: str) -> str:
    return f"""array_to_string(list_transform(string_split({col}, ''), lambda c:
  CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN
    chr(CAST(4352 + (unicode(c) - 44032) // 588 AS INTEGER)) || chr(CAST(4449 + ((unicode(c) - 44032) % 588) // 28 AS INTEGER))
    || CASE WHEN (unicode(c) - 44032) % 28 > 0 THEN chr(CAST(4519 + (unicode(c) - 44032) % 28 AS INTEGER)) ELSE '' END
  ELSE c END), '')"""


def vocab_sql(source: str, specials: tuple[str, ...] = ("[PAD]", "[UNK]")) -> str:
    """V1 restated over a (text) relation."""
    sp = " UNION ALL ".join(f"SELECT '{t}' AS token, {i} AS id" for i, t in enumerate(specials))
    return f"""SELECT token, CAST(id AS BIGINT) AS id FROM (
  {sp}
  UNION ALL
  SELECT token, {len(specials) - 1} + row_number() OVER (ORDER BY token) FROM (
    SELECT DISTINCT unnest(string_split(text, '')) AS token FROM ({source}) src) c
  WHERE token <> '')"""


def split_sql(text: str) -> str:
    """Characters of a string; [] for '' (string_split gives [''] there)."""
    return f"(CASE WHEN {text} = '' THEN [] ELSE string_split({text}, '') END)"


def chars_sql(source: str, key: str, text: str) -> str:
    """(key, pos, ch) for every character, pos 0-based."""
    return f"""SELECT {key} AS k, unnest(range(0, len({split_sql(text)}))) AS pos,
       unnest({split_sql(text)}) AS ch FROM ({source}) s"""


def encode_sql(source: str, key: str, text: str, vocab: str) -> str:
    """V2 restated: (k, ids text, n) with unknown -> 1; rows without characters -> ''."""
    return f"""SELECT s.k, coalesce(e.ids, '') AS ids, coalesce(e.n, 0) AS n FROM (SELECT {key} AS k FROM ({source}) x) s
LEFT JOIN (SELECT c.k, string_agg(CAST(coalesce(v.id, 1) AS VARCHAR), ',' ORDER BY c.pos) AS ids, count(*) AS n
           FROM ({chars_sql(source, key, text)}) c LEFT JOIN {vocab} v ON v.token = c.ch GROUP BY c.k) e ON e.k = s.k"""


VIEWS["ocr_folds"] = (("ocr_train",), _folds_view("row_id"))
VIEWS["ocr_folds_shuffled"] = (("ocr_train",), _folds_view("md5('7:kfold:' || CAST(row_id AS VARCHAR)), row_id"))
VIEWS["bench_vocab"] = ((), vocab_sql("SELECT text FROM benchmark"))
VIEWS["ocr_vocab"] = (("ocr_train",), vocab_sql("SELECT label AS text FROM ocr_train"))
VIEWS["ocr_encoded"] = (("ocr_train", "ocr_vocab"), encode_sql("SELECT * FROM ocr_train", "row_id", "label", "ocr_vocab"))
VIEWS["pred_encoded"] = (
    ("ocr_raw_pred", "ocr_vocab"),
    encode_sql("SELECT row_id * 10 + fold AS key, raw_text FROM ocr_raw_pred", "key", "raw_text", "ocr_vocab"),
)
# shards padded to their own width with 0, then all to the widest with -100
VIEWS["ragged"] = (
    ("pred_encoded",),
    """SELECT k // 10 AS row_id, CAST(k % 10 AS INTEGER) AS fold,
       list_concat(CASE WHEN ids = '' THEN [] ELSE list_transform(string_split(ids, ','), lambda x: CAST(x AS BIGINT)) END,
                   list_transform(range(shard_w - n), lambda x: CAST(0 AS BIGINT)),
                   list_transform(range(all_w - shard_w), lambda x: CAST(-100 AS BIGINT))) AS ids
FROM (SELECT *, max(n) OVER (PARTITION BY k % 10) AS shard_w, max(n) OVER () AS all_w FROM pred_encoded) p""",
)
VIEWS["pred_clean"] = (
    ("ocr_raw_pred",),
    """SELECT row_id, fold, regexp_replace(nfc_normalize(raw_text), '[^가-힣]', '', 'g') AS label, exp(seq_score) AS seq_probs
FROM ocr_raw_pred""",
)
VIEWS["beams_ranked"] = (
    ("ocr_beams",),
    """SELECT row_id, fold, beam, raw_text, seq_score,
       row_number() OVER (PARTITION BY row_id, fold ORDER BY seq_score DESC, beam) AS rank FROM ocr_beams""",
)
VIEWS["beams_collected"] = (
    ("beams_ranked",),
    """SELECT row_id, fold,
       list(struct_pack(rank := CAST(rank AS INTEGER), text := regexp_replace(nfc_normalize(raw_text), '[^가-힣]', '', 'g'),
                        prob := round(exp(seq_score), 6)) ORDER BY rank) AS beams
FROM beams_ranked WHERE rank <= 5 GROUP BY row_id, fold""",
)
NA_LIST = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'n/a', 'nan', 'null')"


def _ids(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: CAST(x AS VARCHAR)), ',')"


SQL["stratified_folds"] = with_views("SELECT row_id, length, fold FROM ocr_folds", "ocr_folds")
SQL["stratified_folds_shuffled"] = with_views("SELECT row_id, length, fold FROM ocr_folds_shuffled", "ocr_folds_shuffled")
SQL["fold_train_set"] = with_views(
    "SELECT row_id, img_path, label, length FROM ocr_fold_table WHERE fold IS NULL OR fold <> 0", "ocr_fold_table"
)
SQL["fold_valid_set"] = with_views("SELECT row_id, img_path, label, length FROM ocr_fold_table WHERE fold = 2", "ocr_fold_table")
SQL["reset_index"] = with_views(
    """SELECT row_number() OVER (ORDER BY fold IS NOT NULL, row_id) - 1 AS train_index, row_id
FROM ocr_fold_table WHERE fold IS NULL OR fold <> 0""",
    "ocr_fold_table",
)
SQL["fold_schedule"] = with_views(
    """SELECT fold, train_rows, CAST(64 AS BIGINT) AS total_batch, epoch_steps, epoch_steps * 10 AS total_steps,
       (epoch_steps * 10) // 10 AS eval_steps, (epoch_steps * 10) // 10 AS save_steps, epoch_steps // 10 AS logging_steps,
       epoch_steps // 2 AS epoch_eval_steps, epoch_steps // 2 AS epoch_save_steps
FROM (SELECT CAST(k.k AS INTEGER) AS fold, CAST(count(*) AS BIGINT) AS train_rows, CAST(count(*) // 64 AS BIGINT) AS epoch_steps
      FROM ocr_fold_table t, range(0, 5) k(k) WHERE t.fold IS NULL OR t.fold <> k.k GROUP BY 1) s""",
    "ocr_fold_table",
)
SQL["length_histogram"] = with_views(
    "SELECT CAST(length(label) AS INTEGER) AS length, count(*) AS n FROM ocr_train GROUP BY 1", "ocr_train"
)
SQL["path_rewrite"] = with_views("SELECT row_id, replace(img_path, './', './data/') AS img_path FROM ocr_train", "ocr_train")
SQL["label_length"] = with_views("SELECT row_id, CAST(length(label) AS INTEGER) AS length FROM ocr_words", "ocr_words")
SQL["short_labels"] = with_views("SELECT row_id, label FROM ocr_words WHERE length(label) = 1", "ocr_words")
SQL["long_labels"] = with_views(
    "SELECT row_id, label, CAST(length(label) AS INTEGER) AS length FROM ocr_words WHERE length(label) > 1", "ocr_words"
)
SQL["to_subchar"] = with_views(f"SELECT row_id, {nfkd_sql('label')} AS subchar FROM ocr_train", "ocr_train")
SQL["nfc_compose"] = with_views(
    f"""SELECT row_id, -1 AS fold, nfc_normalize({nfkd_sql('label')}) AS text FROM ocr_train
UNION ALL SELECT row_id, fold, nfc_normalize({nfkd_sql('raw_text')}) FROM ocr_raw_pred""",
    "ocr_train",
    "ocr_raw_pred",
)
SQL["clean_text"] = with_views(
    "SELECT row_id, fold, regexp_replace(raw_text, '[^가-힣]', '', 'g') AS label FROM ocr_raw_pred", "ocr_raw_pred"
)
SQL["clean_text_latin"] = "SELECT doc_id, regexp_replace(text, '[^a-zA-Z]', '', 'g') AS text_clean FROM documents"
SQL["postprocess_predictions"] = with_views(
    "SELECT row_id, fold, label, round(seq_probs, 6) AS seq_probs FROM pred_clean", "pred_clean"
)
SQL["wrap_bos_eos"] = with_views("SELECT row_id, '<s>' || label || '</s>' AS text FROM ocr_train", "ocr_train")
SQL["seq_probability"] = with_views(
    "SELECT row_id, fold, round(exp(seq_score), 6) AS seq_prob FROM ocr_raw_pred", "ocr_raw_pred"
)
SQL["path_leaf"] = "SELECT page_id, string_split(url, '/')[-1] AS leaf FROM pages"
SQL["run_stamp"] = """SELECT event_id, strftime(ts, '%Y-%m-%d-%H-%M') AS stamp, strftime(ts, '%Y-%H-%M-%S') AS legacy_stamp
FROM events"""
SQL["metric_prefix"] = """WITH e AS (SELECT CAST(user_id % 5 AS INTEGER) AS fold, ts, value AS loss, 1 + event_id % 64 AS n FROM events)
SELECT fold, 'eval_loss' AS metric, round(sum(loss * n) / sum(n), 6) AS value FROM e GROUP BY fold
UNION ALL SELECT fold, 'eval_samples', CAST(sum(n) AS DOUBLE) FROM e GROUP BY fold
UNION ALL SELECT fold, 'eval_runtime', round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) FROM e GROUP BY fold"""
SQL["build_vocab"] = with_views("SELECT token, id FROM char_vocab", "char_vocab")
SQL["encode_labels"] = with_views(
    f"SELECT k AS doc_id, ids AS input_ids FROM ({encode_sql('SELECT * FROM documents', 'doc_id', 'text', 'char_vocab')}) e",
    "char_vocab",
)
SQL["decode_ids"] = with_views(
    f"""SELECT s.doc_id, coalesce(d.text, '') AS text FROM documents s LEFT JOIN (
  SELECT c.k, string_agg(c.ch, '' ORDER BY c.pos) AS text
  FROM ({chars_sql('SELECT * FROM documents', 'doc_id', 'text')}) c
  JOIN char_vocab v ON v.token = c.ch WHERE v.token NOT IN ('[PAD]', '[UNK]') GROUP BY c.k) d ON d.k = s.doc_id""",
    "char_vocab",
)
SQL["has_oov"] = with_views(
    f"""SELECT count(*) > 0 AS has_oov FROM (SELECT 1 FROM ocr_words w, unnest({split_sql('w.label')}) u(ch)
WHERE ch NOT IN (SELECT token FROM bench_vocab) LIMIT 1) x""",
    "ocr_words",
    "bench_vocab",
)
SQL["oov_labels"] = with_views(
    f"""SELECT DISTINCT label FROM (SELECT w.label, unnest({split_sql('w.label')}) AS ch FROM ocr_words w) x
WHERE ch NOT IN (SELECT token FROM bench_vocab)""",
    "ocr_words",
    "bench_vocab",
)
SQL["extend_vocab"] = with_views(
    f"""SELECT token, id FROM char_vocab
UNION ALL
SELECT label AS token, CAST((SELECT max(id) FROM char_vocab) + row_number() OVER (ORDER BY label) AS BIGINT) AS id
FROM (SELECT DISTINCT label FROM (SELECT w.label, unnest({split_sql('w.label')}) AS ch FROM ocr_words w) x
      WHERE ch NOT IN (SELECT token FROM char_vocab)) n
WHERE label NOT IN (SELECT token FROM char_vocab)""",
    "char_vocab",
    "ocr_words",
)
SQL["oov_after_extension"] = "SELECT count(*) > 0 AS has_oov FROM documents WHERE false"
SQL["load_vocab_lines"] = SQL["extend_vocab"]
VIEWS["special_vocab"] = ((), vocab_sql("SELECT text FROM benchmark", ("[PAD]", "[UNK]", "<s>", "</s>")))
SQL["special_ids"] = with_views(
    """SELECT max(CASE WHEN token = '[PAD]' THEN id END) AS pad_id, max(CASE WHEN token = '[UNK]' THEN id END) AS unk_id,
       coalesce(max(CASE WHEN token = '[CLS]' THEN id END), max(CASE WHEN token = '<s>' THEN id END)) AS start_id,
       coalesce(max(CASE WHEN token = '[SEP]' THEN id END), max(CASE WHEN token = '</s>' THEN id END)) AS end_id,
       count(*) AS vocab_size FROM special_vocab""",
    "special_vocab",
)
SQL["batch_assign"] = with_views("SELECT row_id, row_id // 64 AS batch_id FROM ocr_train", "ocr_train")
SQL["pad_to_batch_max"] = with_views(
    """SELECT k AS row_id, k // 64 AS batch_id, ids || repeat(',0', CAST(max(n) OVER (PARTITION BY k // 64) - n AS INTEGER)) AS input_ids
FROM ocr_encoded""",
    "ocr_encoded",
)
SQL["pad_to_max_length"] = with_views(
    "SELECT k AS row_id, ids || repeat(',0', CAST(greatest(0, 32 - n) AS INTEGER)) AS input_ids FROM ocr_encoded",
    "ocr_encoded",
)
SQL["ragged_concat"] = with_views(f"SELECT row_id, fold, {_ids('ids')} AS pred_ids FROM ragged", "ragged")
SQL["mask_to_pad"] = with_views(
    f"SELECT row_id, fold, {_ids('list_transform(ids, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END)')} AS ids FROM ragged",
    "ragged",
)
SQL["top_k_beams"] = with_views(
    """SELECT row_id, fold, CAST(rank AS INTEGER) AS rank, beam, raw_text, round(seq_score, 6) AS seq_score
FROM beams_ranked WHERE rank <= 3""",
    "beams_ranked",
)
SQL["best_beam"] = with_views(
    "SELECT row_id, fold, beam, raw_text, round(seq_score, 6) AS seq_score FROM beams_ranked WHERE rank = 1",
    "beams_ranked",
)
SQL["zip_beams"] = with_views(
    """SELECT a.row_id, a.fold, a.beam, a.raw_text, round(b.seq_score, 6) AS seq_score
FROM ocr_beams a JOIN ocr_beams b ON a.row_id = b.row_id AND a.fold = b.fold AND a.beam = b.beam""",
    "ocr_beams",
)
SQL["collect_beams"] = with_views(
    """SELECT row_id, fold, array_to_string(list_transform(beams, lambda b: b.text), '|') AS labels,
       array_to_string(list_transform(beams, lambda b: CAST(CAST(round(b.prob * 1e6) AS BIGINT) AS VARCHAR)), ',') AS probs
FROM beams_collected""",
    "beams_collected",
)
SQL["beams_json"] = with_views("SELECT row_id, fold, CAST(to_json(beams) AS VARCHAR) AS beams_json FROM beams_collected", "beams_collected")
SQL["ensemble_logit_sum"] = with_views(
    """SELECT row_id, step, token_id, round(sum(logit), 6) AS logit_sum, count(*) AS n_folds
FROM logits GROUP BY row_id, step, token_id""",
    "logits",
)
SQL["ensemble_argmax"] = with_views(
    """SELECT row_id, step, token_id, logit_sum FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id, step ORDER BY logit_sum DESC, token_id) AS rn
  FROM (SELECT row_id, step, token_id, round(sum(logit), 6) AS logit_sum FROM logits GROUP BY ALL) s) r WHERE rn = 1""",
    "logits",
)
SQL["ensemble_vote"] = with_views(
    """SELECT row_id, label, round(score, 6) AS score, votes FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(score, 6) DESC, label) AS rn
  FROM (SELECT row_id, label, sum(seq_probs) AS score, count(*) AS votes FROM pred_clean GROUP BY row_id, label) s) r
WHERE rn = 1""",
    "pred_clean",
)
SQL["exact_match_accuracy"] = with_views(
    """SELECT p.fold, round(avg(CASE WHEN p.raw_text = t.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n
FROM ocr_raw_pred p JOIN ocr_train t ON p.row_id = t.row_id GROUP BY p.fold""",
    "ocr_raw_pred",
)
SQL["exact_match_accuracy_postprocessed"] = with_views(
    """SELECT p.fold, round(avg(CASE WHEN regexp_replace(nfc_normalize(p.raw_text), '[^가-힣]', '', 'g')
                                   = regexp_replace(nfc_normalize(t.label), '[^가-힣]', '', 'g') THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       count(*) AS n
FROM ocr_raw_pred p JOIN ocr_train t ON p.row_id = t.row_id GROUP BY p.fold""",
    "ocr_raw_pred",
)
SQL["exact_match_accuracy_gaps"] = with_views(
    """SELECT f.fold, round(sum(CASE WHEN p.raw_text = t.label AND p.row_id % 7 <> 2 THEN 1 ELSE 0 END) / count(*), 6) AS accuracy, count(*) AS n
FROM ocr_train t CROSS JOIN (SELECT CAST(range AS INTEGER) AS fold FROM range(0, 5)) f
LEFT JOIN (SELECT * FROM ocr_raw_pred WHERE row_id % 11 <> 3) p ON p.row_id = t.row_id AND p.fold = f.fold GROUP BY f.fold""",
    "ocr_raw_pred",
)
SQL["optional_label_metrics"] = """SELECT d.source, d.lang, count(*) AS n_pred, count(l.quality) AS n_ref,
       round(avg(CASE WHEN l.quality IS NULL THEN NULL WHEN CAST(d.n_chars > 1000 AS INTEGER) = l.quality THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source, d.lang"""
SQL["weighted_mean_loss"] = with_views(
    "SELECT fold, round(sum(loss * n) / sum(n), 6) AS mean_loss, CAST(sum(n) AS BIGINT) AS n_samples FROM step_log GROUP BY fold",
    "step_log",
)
SQL["sample_count"] = with_views(
    "SELECT fold, count(*) AS n_rows, count(DISTINCT row_id) AS n_samples FROM ocr_beams GROUP BY fold", "ocr_beams"
)
SQL["throughput"] = """SELECT fold, round(rt, 6) AS eval_runtime, n AS eval_samples, round(n / rt, 6) AS eval_samples_per_second,
       CAST(ceil(n / 64) AS BIGINT) AS eval_steps, round(ceil(n / 64) / rt, 6) AS eval_steps_per_second
FROM (SELECT CAST(user_id % 5 AS INTEGER) AS fold, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS rt, count(*) AS n
      FROM events GROUP BY 1) s"""
SQL["truncate_padded"] = with_views(
    "SELECT fold, row_id AS sample, row_id, raw_text FROM ocr_raw_pred WHERE row_id < (SELECT count(*) FROM ocr_train)", "ocr_raw_pred"
)
SQL["best_checkpoint"] = """SELECT fold, step AS best_step, value AS best_accuracy FROM (
  SELECT CAST(user_id % 5 AS INTEGER) AS fold, event_id AS step, value,
         row_number() OVER (PARTITION BY user_id % 5 ORDER BY value DESC, event_id) AS rn FROM events) r WHERE rn = 1"""
SQL["retain_latest"] = """SELECT fold, step, CAST(recency AS INTEGER) AS recency FROM (
  SELECT CAST(user_id % 5 AS INTEGER) AS fold, event_id AS step,
         row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id DESC) AS recency FROM events) r WHERE recency <= 2"""
SQL["seeded_uniform"] = with_views(f"SELECT row_id, {u_sql(chr(39) + '42' + chr(39), chr(39) + 'draw' + chr(39), 'row_id')} AS u FROM ocr_train", "ocr_train")


def _u(name: str) -> str:
    return u_sql("'42'", f"'{name}'", "row_id")


_PLAN = f"""SELECT row_id, {_u('rotate')} < 0.5 AS rotate, {_u('compose')} < 0.8 AS compose,
       CASE WHEN {_u('flip')} < 0.5 THEN -({_u('angle')} * 20.0) ELSE {_u('angle')} * 20.0 END AS angle0,
       ['pixelate', 'gaussian_blur', 'gaussian_noise_gray', 'jpeg_compression'][CAST(floor({_u('resolution')} * 4) AS INTEGER) + 1] AS res,
       ['defocus_blur', 'motion_blur', 'glass_blur'][CAST(floor({_u('shake')} * 3) AS INTEGER) + 1] AS shake,
       CAST(floor({_u('glass')} * 3) AS INTEGER) AS level
FROM ocr_train"""
VIEWS["aug_plan"] = (
    ("ocr_train",),
    f"""SELECT row_id, rotate, CASE WHEN rotate THEN round(angle0, 6) END AS angle, CASE WHEN rotate THEN 192 END AS side,
       compose, CASE WHEN compose THEN res END AS resolution_op, CASE WHEN compose THEN shake END AS shake_op,
       CASE WHEN compose AND shake = 'glass_blur' THEN level END AS glass_level
FROM ({_PLAN}) p""",
)
SQL["augment_plan"] = with_views("SELECT * FROM aug_plan", "aug_plan")
SQL["augment_mix"] = with_views(
    "SELECT rotate, compose, resolution_op, shake_op, glass_level, count(*) AS n FROM aug_plan GROUP BY ALL", "aug_plan"
)
SQL["build_submission"] = with_views(
    """SELECT t.row_id, t.img_path, regexp_replace(nfc_normalize(b.raw_text), '[^가-힣]', '', 'g') AS label,
       round(exp(b.seq_score), 6) AS seq_probs
FROM ocr_test t JOIN beams_ranked b ON b.row_id = t.row_id AND b.fold = 0 AND b.rank = 1""",
    "ocr_test",
    "beams_ranked",
)
SQL["submission_audit"] = """SELECT CAST(sum(coalesce(s, 0)) AS BIGINT) AS submission_rows, CAST(sum(coalesce(p, 0)) AS BIGINT) AS prediction_rows,
       count(*) FILTER (WHERE p IS NULL) AS missing, count(*) FILTER (WHERE s IS NULL) AS extra,
       count(*) FILTER (WHERE p > 1) AS duplicate_keys, count(*) FILTER (WHERE s > 1) AS duplicate_submission_keys
FROM (SELECT doc_id, count(*) AS s FROM documents GROUP BY 1) a
FULL OUTER JOIN (SELECT doc_id, count(*) AS p FROM labels GROUP BY 1) b USING (doc_id)"""
SQL["label_universe"] = with_views(
    f"""SELECT row_number() OVER (ORDER BY label) - 1 AS pos, label, {nfkd_sql('label')} AS subchar
FROM (SELECT DISTINCT label FROM ocr_fold_table) u""",
    "ocr_fold_table",
)
SQL["write_folds"] = with_views("SELECT row_id, img_path, label, length, fold FROM ocr_fold_table", "ocr_fold_table")
SQL["discover_folds"] = with_views(
    "SELECT row_id, fold, label, round(seq_probs, 6) AS seq_probs FROM pred_clean WHERE fold = 2", "pred_clean"
)
SQL["scan_label_csv"] = with_views(
    f"""SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, img_path,
       CASE WHEN label IN {NA_LIST} THEN NULL ELSE label END AS label FROM ocr_words""",
    "ocr_words",
)
SQL["load_dataset"] = with_views(
    f"SELECT row_id, img_path AS pixel_values, {nfkd_sql('label')} AS labels FROM ocr_train", "ocr_train"
)
SQL["write_submission"] = SQL["build_submission"]
SQL["load_vocab"] = SQL["build_vocab"]
SQL["batch_predict"] = """WITH c AS (
  SELECT label AS c_label, i, avg(CAST(v AS DOUBLE)) AS m
  FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) x GROUP BY label, i),
d AS (
  SELECT e.vec_id, e.label, c.c_label, sum((CAST(e.v AS DOUBLE) - c.m) * (CAST(e.v AS DOUBLE) - c.m)) AS dist
  FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) e
  JOIN c ON c.i = e.i GROUP BY e.vec_id, e.label, c.c_label)
SELECT vec_id, label, CAST(c_label AS INTEGER) AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, c_label) AS rn FROM d) r WHERE rn = 1"""
_listed = "CASE WHEN ids = '' THEN [] ELSE list_transform(string_split(ids, ','), lambda x: CAST(x AS BIGINT)) END"
SQL["batch_generate"] = with_views(
    f"""SELECT k // 10 AS row_id, CAST(k % 10 AS INTEGER) AS fold, coalesce(s.ids, '') AS ids, round(coalesce(s.score, 0.0), 6) AS score
FROM pred_encoded LEFT JOIN (
  SELECT k, string_agg(CAST(nxt AS VARCHAR), ',' ORDER BY pos) AS ids, sum(ln(share)) AS score
  FROM (SELECT k, unnest(l) AS id, unnest(range(len(l))) AS pos FROM (SELECT k, {_listed} AS l FROM pred_encoded) y) x
  JOIN (SELECT id, nxt, n / sum(n) OVER (PARTITION BY id) AS share, row_number() OVER (PARTITION BY id ORDER BY n DESC, nxt) AS rn
        FROM (SELECT id, nxt, count(*) AS n FROM (SELECT unnest(l[1:len(l) - 1]) AS id, unnest(l[2:]) AS nxt FROM (SELECT {_listed} AS l FROM ocr_encoded) y) z GROUP BY id, nxt) c) b
    ON b.id = x.id AND b.rn = 1
  GROUP BY k) s USING (k)""",
    "pred_encoded",
    "ocr_encoded",
)
SQL["k_best_sequences"] = with_views(
    """SELECT row_id, CAST(rank AS INTEGER) AS rank, tokens, score FROM (
  SELECT a.row_id, CAST(a.token AS VARCHAR) || ',' || CAST(b.token AS VARCHAR) AS tokens, round(a.v + b.v, 6) AS score,
         row_number() OVER (PARTITION BY a.row_id ORDER BY round((a.v + b.v) * 1000000) DESC, a.token, b.token) AS rank
  FROM s a JOIN s b ON a.row_id = b.row_id AND a.step = 0 AND b.step = 1) r WHERE rank <= 5""",
    "logits",
).replace(
    "SELECT row_id, CAST(rank",
    """, h AS (SELECT CAST((max(token_id) + 1) / 2 AS INTEGER) AS half FROM logits),
s AS (SELECT row_id, CASE WHEN token_id < half THEN 0 ELSE 1 END AS step, token_id % half AS token, round(sum(logit), 6) AS v FROM logits, h GROUP BY row_id, token_id, half)
SELECT row_id, CAST(rank""",
    1,
)
SQL["shard_merge"] = SQL["weighted_mean_loss"]
SQL["streaming_late_references"] = SQL["optional_label_metrics"]
SQL["streaming_running_metric"] = SQL["weighted_mean_loss"]
SQL["fold_leak_check"] = with_views(
    """SELECT count(t.row_id) AS leaked_rows, count(*) AS valid_rows
FROM (SELECT row_id FROM ocr_fold_table WHERE fold = 0) v
LEFT JOIN (SELECT DISTINCT row_id FROM ocr_fold_table WHERE fold IS NULL OR fold <> 0) t ON t.row_id = v.row_id""",
    "ocr_fold_table",
)
SQL["oov_chars"] = with_views(
    f"""SELECT DISTINCT ch AS token FROM (SELECT unnest({split_sql('label')}) AS ch FROM ocr_words) x
WHERE ch NOT IN (SELECT token FROM bench_vocab)""",
    "ocr_words",
    "bench_vocab",
)
SQL["streaming_running_accuracy"] = with_views(
    """SELECT p.fold, CAST(sum(CASE WHEN p.raw_text = t.label AND p.row_id % 5 <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS n
FROM ocr_raw_pred p JOIN ocr_train t ON p.row_id = t.row_id GROUP BY p.fold""",
    "ocr_raw_pred",
)
SQL["kfold_submission"] = with_views(
    """SELECT t.row_id, t.img_path, b.fold, regexp_replace(nfc_normalize(b.raw_text), '[^가-힣]', '', 'g') AS label,
       round(exp(b.seq_score), 6) AS seq_probs
FROM ocr_test t JOIN beams_ranked b ON b.row_id = t.row_id AND b.rank = 1""",
    "ocr_test",
    "beams_ranked",
)
SQL["per_batch_transform"] = with_views(
    """SELECT row_id, CAST(length(label) AS INTEGER) AS n_chars,
       CAST(length(regexp_replace(label, '[^가-힣]', '', 'g')) AS INTEGER) AS n_syllables FROM ocr_train""",
    "ocr_train",
)
VIEWS["word_folds"] = (("ocr_words",), _folds_view("row_id", "ocr_words"))
SQL["stratified_folds_words"] = with_views("SELECT row_id, length, fold FROM word_folds", "word_folds")
SQL["ensemble_dense_argmax"] = SQL["ensemble_argmax"]
SQL["length_grouped_batches"] = with_views(
    """SELECT row_id, CAST(length(label) AS INTEGER) AS length,
       (row_number() OVER (ORDER BY length(label), row_id) - 1) // 64 AS batch_id FROM ocr_words""",
    "ocr_words",
)
SQL["preprocess_folds"] = SQL["write_folds"]
SQL["evaluate_predictions"] = with_views(
    f"""SELECT p.fold, round(avg(CASE WHEN coalesce(d.text, '') = t.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n
FROM ocr_raw_pred p
LEFT JOIN (SELECT c.k, string_agg(c.ch, '' ORDER BY c.pos) AS text
           FROM ({chars_sql('SELECT row_id * 10 + fold AS key, raw_text FROM ocr_raw_pred', 'key', 'raw_text')}) c
           JOIN ocr_vocab v ON v.token = c.ch WHERE v.token NOT IN ('[PAD]', '[UNK]') GROUP BY c.k) d ON d.k = p.row_id * 10 + p.fold
JOIN ocr_train t ON t.row_id = p.row_id
GROUP BY p.fold""",
    "ocr_raw_pred",
    "ocr_vocab",
)
