"""The queries of ``queries`` in SQL, over the same tables; written from the definitions, not from the plans.

Not here, because SQL cannot say them: queries that train or use a classifier.
"""

from __future__ import annotations

from textbench.fixed import (
    LABELS,
    MISSING_STRINGS,
    WHITESPACE,
)


def text(value: str) -> str:
    """A string literal; characters that do not print are spelled out with chr()."""
    parts, plain = [], ""
    for ch in value:
        if ch.isprintable():
            plain += ch
            continue
        if plain:
            parts.append("'" + plain.replace("'", "''") + "'")
            plain = ""
        parts.append(f"chr({ord(ch)})")
    if plain or not parts:
        parts.append("'" + plain.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


LABEL_ROWS = ", ".join(f"({i}::bigint, '{label}')" for i, label in enumerate(LABELS))
LABEL_IN = ", ".join(f"'{label}'" for label in LABELS)
LABEL_ID = "case label " + " ".join(f"when '{label}' then {i}::bigint" for i, label in enumerate(LABELS)) + " end"


def label_name(column: str) -> str:
    return f"case {column} " + " ".join(f"when {i} then '{label}'" for i, label in enumerate(LABELS)) + " end"


# -- derived frames -------------------------------------------------------------

BASE = f"""
label_list(label_id, label) as (values {LABEL_ROWS}),
labelled as (
  select doc_id as row_id, text, lang,
    case when doc_id % 100 < 39 then 'neutral' when doc_id % 100 < 62 then 'joy'
         when doc_id % 100 < 79 then 'love' when doc_id % 100 < 93 then 'anger'
         when doc_id % 100 < 99 then 'sadness' else 'fear' end as label,
    case when (doc_id // 100 * 37 + doc_id) % 20 < 14 then 'train'
         when (doc_id // 100 * 37 + doc_id) % 20 < 17 then 'val' else 'test' end as split
  from documents),
train as (select row_id, text, label, {LABEL_ID} as label_id from labelled where split = 'train'),
dirty as (
  select row_id, case when row_id % 50 = 9 then null else text end as text,
    case when row_id % 50 = 7 then 'surprise' else label end as label, split
  from labelled),
predictions as (
  select m.model, row_id, text, label as true_label,
    case when (row_id * 13 + m.k) % 10 < m.good then label
         else case (row_id * 7 + m.k) % 6 when 0 then 'joy' when 1 then 'sadness' when 2 then 'anger'
              when 3 then 'fear' when 4 then 'love' else 'neutral' end end as pred_label
  from (select *, unnest([{{'model': 'tuned', 'k': 0, 'good': 6}}, {{'model': 'few', 'k': 1, 'good': 2}},
                          {{'model': 'zero', 'k': 2, 'good': 0}}]) as m from labelled)),
raw_outputs as (
  select model, row_id, text, true_label,
    case when row_id % 33 = 0 then 'pain' || chr(10) || chr(10) || 'Explanation:'
         when row_id % 11 = 0 then 'Not SADNESS but ' || pred_label
         when row_id % 17 = 0 then 'x Emotion: anger Emotion: ' || chr(10) || upper(pred_label) || ' '
         when row_id % 19 = 0 then null
         else pred_label || chr(10) || chr(10) || 'Explanation: The given "text" expresses' end as raw_output
  from predictions),
logits as (
  select vec_id as row_id, list_transform([0, 1, 2, 3, 4, 5], lambda k: list_sum(list_transform(list_slice(embedding, k + 1, len(embedding), 6), lambda x: x::double))) as z, (label % 6)::bigint as y
  from embeddings),
event_positions as (
  select user_id as run_id, event_id, value, row_number() over (partition by user_id order by event_id) - 1 as position
  from events),
epoch_log as (
  select run_id, position + 1 as epoch, ((event_id * 37) % 1000)::double / 1000.0 as val_f1 from event_positions),
batch_log as (
  select run_id, position // 5 + 1 as epoch, position % 5 as batch, value as loss from event_positions)
"""


def sql(body: str, *more: str) -> str:
    """A query over the derived frames, with further named parts before it."""
    return "with " + ",\n".join([BASE, *more]) + "\n" + body


# -- metrics ----------------------------------------------------------------------


def per_class(labels=LABELS) -> str:
    """One row per model and listed label; the counts come from three plain group-bys."""
    listed = ", ".join(f"{{'label_id': {i}::bigint, 'label': '{label}'}}" for i, label in enumerate(labels))
    return f"""
listed as (select model, unnest([{listed}], recursive := true) from (select distinct model from predictions)),
supports as (select model, true_label as label, count(*) as support from predictions group by all),
predicteds as (select model, pred_label as label, count(*) as predicted from predictions group by all),
hits as (select model, true_label as label, count(*) as tp from predictions where true_label = pred_label group by all),
counted as (
  select model, label_id, label,
    coalesce(tp, 0) as tp, coalesce(predicted, 0) as predicted, coalesce(support, 0) as support
  from listed left join supports using (model, label)
    left join predicteds using (model, label) left join hits using (model, label)),
per_class as (
  select *, case when predicted > 0 then tp::double / predicted else 0 end as precision,
    case when support > 0 then tp::double / support else 0 end as recall,
    case when predicted + support > 0 then 2.0::double * tp / (predicted + support) else 0 end as f1
  from counted),
rights as (select model, count(*) as n, avg((true_label = pred_label)::int::double) as accuracy from predictions group by model),
averages as (
  select model, avg(f1) as macro_f1, avg(precision) as macro_p, avg(recall) as macro_r,
    coalesce(2.0::double * sum(tp) / nullif(sum(predicted) + sum(support), 0), 0) as micro_f1,
    coalesce(sum(tp)::double / nullif(sum(predicted), 0), 0) as micro_p,
    coalesce(sum(tp)::double / nullif(sum(support), 0), 0) as micro_r,
    coalesce(sum(f1 * support) / nullif(sum(support), 0), 0) as weighted_f1,
    coalesce(sum(precision * support) / nullif(sum(support), 0), 0) as weighted_p,
    coalesce(sum(recall * support) / nullif(sum(support), 0), 0) as weighted_r,
    sum(support)::bigint as support, sum(predicted)::bigint as predicted
  from per_class group by model),
summary as (select * from averages join rights using (model))"""


RANKED = """
ranked as (
  select row_number() over (order by macro_f1 desc, case model when 'tuned' then 1 when 'few' then 2 else 3 end) as rank,
    model, macro_f1, accuracy, n from summary)"""


def two(column: str) -> str:
    return f"printf('%.2f', {column})::double"


def report(labels=LABELS) -> str:
    k = len(labels)
    whole = "support + predicted = 2 * n"
    return sql(
        f"""
select model, label_id as line_no, label, {two('precision')} as precision, {two('recall')} as recall, {two('f1')} as f1, support
from per_class
union all
select model, {k}, case when {whole} then 'accuracy' else 'micro avg' end,
  case when {whole} then null else {two('micro_p')} end, case when {whole} then null else {two('micro_r')} end,
  case when {whole} then {two('accuracy')} else {two('micro_f1')} end, support from summary
union all
select model, {k + 1}, 'macro avg', {two('macro_p')}, {two('macro_r')}, {two('macro_f1')}, support from summary
union all
select model, {k + 2}, 'weighted avg', {two('weighted_p')}, {two('weighted_r')}, {two('weighted_f1')}, support from summary""",
        per_class(labels),
    )


def metrics_lines() -> str:
    head = ["=" * 50, "EVALUATION METRICS", "=" * 50, ""]
    middle = ["", "-" * 50, "PER-CLASS METRICS", "-" * 50, ""]
    parts = [f"select model, {i + 1}::bigint as line_no, '{line}' as line from summary" for i, line in enumerate(head)]
    for i, (name, field) in enumerate(
        [("Accuracy", "accuracy"), ("Macro F1", "macro_f1"), ("Micro F1", "micro_f1"), ("Weighted F1", "weighted_f1")]
    ):
        parts.append(f"select model, {5 + i}, '{name}: ' || printf('%.4f', {field}) from summary")
    parts += [f"select model, {9 + i}, '{line}' from summary" for i, line in enumerate(middle)]
    block = [
        "label || ':'",
        "'  Precision: ' || printf('%.4f', precision)",
        "'  Recall: ' || printf('%.4f', recall)",
        "'  F1: ' || printf('%.4f', f1)",
        "'  Support: ' || support",
        "''",
    ]
    parts += [f"select model, 14 + 6 * label_id + {i}, {line} from per_class" for i, line in enumerate(block)]
    return sql("\nunion all ".join(parts), per_class())


COMPARISON_LINES = sql(
    """
select 1::bigint as line_no, repeat('=', 60) as line
union all select 2, 'EVALUATION REPORT'
union all select 3, repeat('=', 60)
union all select 4, ''
union all select 5, 'Model Comparison (Macro F1 Score):'
union all select 6, repeat('-', 40)
union all select 6 + rank, printf('%-20s %.4f %s', model, macro_f1, repeat('█', floor(macro_f1 * 40)::bigint)) from ranked
union all select 7 + count(*), '' from ranked
union all select 8 + count(*), repeat('-', 40) from ranked
union all select 9 + count(*), 'Key Finding: ' || max(case when rank = 1 then model end) || ' has the best macro F1' from ranked
union all select 10 + count(*), 'of ' || count(*) || ' compared models.' from ranked
union all select 11 + count(*), repeat('=', 60) from ranked""",
    per_class(),
    RANKED,
)

# -- parsing -------------------------------------------------------------------------

PARSED = "parsed as (select *, coalesce(" + ", ".join(
    f"case when contains(lower(raw_output), '{label}') then '{label}' end" for label in LABELS
) + ", 'neutral') as pred_label, " + " + ".join(
    f"coalesce(contains(lower(raw_output), '{label}'), false)::int::bigint" for label in LABELS
) + " as n_found from raw_outputs)"


def response(column: str) -> str:
    """What follows the last marker, found by cutting at every marker."""
    return (
        f"case when contains({column}, 'Emotion:') then trim(string_split({column}, 'Emotion:')[-1], {text(WHITESPACE)}) "
        f"else {column} end"
    )


# fixed values: both whole prompts, around the text
ZERO_SHOT = """You are an emotion classifier for song lyrics.

Possible emotions: joy, sadness, anger, fear, love, neutral.

Classify the emotion of the following lyric.
Answer with ONLY one word from this list: joy, sadness, anger, fear, love, neutral.

Lyric: <text>
Emotion:"""
FEW_SHOT = """You are an emotion classifier for song lyrics.

Possible emotions: joy, sadness, anger, fear, love, neutral.

Here are labeled examples:

Lyric: I'm walking on sunshine and it feels so good
Emotion: joy

Lyric: I cry myself to sleep every night
Emotion: sadness

Lyric: I hate everything you put me through
Emotion: anger

Lyric: Every noise in the dark makes me tremble
Emotion: fear

Lyric: I'd cross the ocean just to hold you close
Emotion: love

Lyric: It's just another normal day, nothing special
Emotion: neutral

Classify the emotion of the following lyric.
Answer with ONLY one word from this list: joy, sadness, anger, fear, love, neutral.

Lyric: <text>
Emotion:"""
PROMPTS = {"zero-shot": ZERO_SHOT, "few-shot": FEW_SHOT}


def prompt(mode: str, column: str) -> str:
    before, after = PROMPTS[mode].split("<text>")
    return f"{text(before)} || coalesce({column}, 'nan') || {text(after)}"


ANSWERS = ["joy", "SADNESS\n\nExplanation: sad", "no idea", "love, not anger", " neutral ", "fear"]
ANSWER_LIST = "[" + ", ".join(text(a) for a in ANSWERS) + "]"
GENERATED = f"""
prompts as (select *, {prompt('few-shot', 'text')} as prompt from labelled),
generated as (select *, prompt || {ANSWER_LIST}[length(prompt) % {len(ANSWERS)} + 1] as raw_output from prompts)"""
STUB_PREDICTIONS = f"""
predictions as (
  select 'stub' as model, row_id, text, true_label, pred_label, response as raw_output from (
    select row_id, text, label as true_label, {response('raw_output')} as response,
      coalesce({", ".join(f"case when contains(lower({response('raw_output')}), '{label}') then '{label}' end" for label in LABELS)},
               'neutral') as pred_label
    from generated where split = 'test'))"""

# -- logits ------------------------------------------------------------------------------

ALPHA = "[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]"
SCORED = f"""
exps as (select row_id, y, z, list_transform(z, lambda x: exp(x - list_max(z))) as e from logits),
scored as (
  select row_id, y, list_position(z, list_max(z))::bigint - 1 as pred,
    list_transform(e, lambda x: x / list_sum(e)) as p, (e[y + 1] / list_sum(e)) as p_true
  from exps),
losses as (
  select row_id, y, -ln(p_true) as ce, 0.9::double * -ln(p_true) + 0.1::double / 6 * list_sum(list_transform(p, lambda x: -ln(x))) as ce_smooth,
    power(1 - p_true, 2) as factor, {ALPHA}[y + 1]::double as alpha
  from scored)"""

CLASS_COUNTS = """
class_counts as (
  select label_id, label_list.label, count(train.label_id) as n
  from label_list left join train using (label_id) group by all)"""

# -- tokens ---------------------------------------------------------------------------------


def tokens_of(source: str, *keys: str) -> str:
    names = "".join(f"{k}, " for k in keys)
    return f"(select {names}unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as token from {source})"


VOCABULARY = 5000


def vocabulary(source: str) -> str:
    return f"""
vocabulary as (
  select token, row_number() over (order by n desc, token) + 1 as token_id, n
  from (select token, count(*) as n from {tokens_of(source)} group by token order by n desc, token limit {VOCABULARY}))"""


# -- sampling ----------------------------------------------------------------------------------


def uniform(digest: str, start: int, digits: int) -> str:
    return f"('0x' || substr({digest}, {start}, {digits}))::bigint"


SAMPLE = f"""
classes as (
  select label_id, n, sum(n / (n + 0.000001::double)) over (order by label_id rows unbounded preceding) as upto,
    sum(n / (n + 0.000001::double)) over () as total
  from class_counts where n > 0),
draws as (
  select row_id as draw_id, {uniform("md5('42:draw:' || row_id)", 1, 13)}::double / 4503599627370496.0::double as u_class,
    {uniform("md5('42:draw:' || row_id)", 14, 13)}::double / 4503599627370496.0::double as u_row
  from train),
picked as (
  select draw_id, u_row,
    (select min(label_id) from classes where draws.u_class * total < upto) as label_id
  from draws),
placed as (
  select row_id, label_id, row_number() over (partition by label_id
    order by {uniform("md5('42:row:' || row_id)", 1, 4)}, row_id) - 1 as position
  from train)"""

ORACLES: dict[str, str] = {
    # sources and sinks
    "read_labelled": sql(
        f"""select row_id, case when text is null or text in ({", ".join(text(m) for m in MISSING_STRINGS)}) then 'nan' else text end as text,
  label from dirty"""
    ),
    "read_splits": sql(
        f"""select split, count(*) as n, sum(length(text))::bigint as chars, count(*) filter (text = 'nan') as n_missing from (
  select split, case when text is null or text in ({", ".join(text(m) for m in MISSING_STRINGS)}) then 'nan' else text end as text from dirty)
group by split"""
    ),
    "read_predictions": sql("select model, row_id, true_label, pred_label from predictions where model = 'tuned'"),
    "read_available_predictions": sql(
        "select model, row_id, true_label, pred_label from predictions where model in ('tuned', 'few')"
    ),
    "write_predictions": sql(
        """select model, row_id, substr(text, 1, 200) as text, true_label, pred_label,
  coalesce(substr(raw_output, 1, 100), '') as raw_output from parsed""",
        PARSED,
    ),
    "metrics_report": metrics_lines(),
    "comparison_report": COMPARISON_LINES,
    # projections, predicates, scalar functions
    "encode_label": sql(
        f"select row_id, label, coalesce({LABEL_ID}, 0) as label_id, label in ({LABEL_IN}) as known from dirty"
    ),
    "encode_label_resolved": sql(
        f"""select row_id, label, coalesce(mapping.id, 0) as label_id, mapping.id is not null as known
from dirty left join (
  select label, row_number() over (order by label) - 1 as id from (
    select distinct label from dirty where split = 'train' and exists (select 1 from dirty where label not in ({LABEL_IN})))
  union all select label, label_id from label_list where not exists (select 1 from dirty where label not in ({LABEL_IN}))
) as mapping using (label)"""
    ),
    "decode_label": sql(
        f"select row_id, {label_name('y')} as true_label, {label_name('pred')} as pred_label from scored", SCORED
    ),
    "label_in_range": sql(f"select row_id, label, {LABEL_ID} as label_id from dirty where label in ({LABEL_IN})"),
    "build_prompt_zero": sql(f"select row_id, {prompt('zero-shot', 'text')} as prompt from dirty"),
    "build_prompt_few": sql(f"select row_id, {prompt('few-shot', 'text')} as prompt from dirty"),
    "extract_response": sql(f"select model, row_id, {response('raw_output')} as response from raw_outputs"),
    "parse_outputs": sql("select model, row_id, true_label, pred_label, n_found from parsed", PARSED),
    "parse_counts": sql("select model, pred_label, n_found, count(*) as n from parsed group by all", PARSED),
    "truncate_output": sql(
        """select model, row_id, substr(text, 1, 200) as text, coalesce(substr(raw_output, 1, 100), '') as raw_output
from raw_outputs"""
    ),
    "encode_tokens": sql(
        """select row_id, array_to_string(list_concat(ids, list_transform(range(256 - len(ids)), lambda x: 0)), ' ') as input_ids,
  array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(256 - len(ids)), lambda x: 0)), ' ') as attention_mask
from (select row_id, coalesce(ids, []) as ids from labelled left join encoded using (row_id))""",
        vocabulary("train"),
        r"""
positions as (
  select row_id, unnest(words) as token, generate_subscripts(words, 1) as position
  from (select row_id, regexp_extract_all(lower(text), '\p{L}+')[1:256] as words from labelled)),
encoded as (
  select row_id, list(coalesce(token_id, 1) order by position) as ids
  from positions left join vocabulary using (token) group by row_id)""",
    ),
    "score_logits": sql(
        "select row_id, y, pred, round(p_true, 6) as p_true, "
        + ", ".join(f"round(p[{i + 1}], 6) as p_{label}" for i, label in enumerate(LABELS))
        + " from scored",
        SCORED,
    ),
    "score_counts": sql("select y, pred, count(*) as n from scored group by all", SCORED),
    "cross_entropy": sql("select row_id, y, round(ce, 6) as loss, round(ce_smooth, 6) as loss_smoothed from losses", SCORED),
    "focal_loss": sql(
        """select row_id, y, round(factor * ce, 6) as loss, round(factor * ce_smooth * alpha, 6) as loss_alpha_smoothed
from losses""",
        SCORED,
    ),
    # joins
    "zero_filled_counts": sql(
        """select label_id, listed.label, count(labelled.label) as n
from (from label_list union all select 6::bigint, 'surprise') as listed left join labelled using (label) group by all"""
    ),
    "attach_class_weight": sql(
        """select row_id, label, label_id, round((select count(*) from train)::double / (6 * n), 6) as weight
from train join (select label_id, count(*) as n from train group by label_id) using (label_id)"""
    ),
    "paired_predictions": sql(
        """select a.model as model_a, b.model as model_b,
  (select count(*) from predictions where model = a.model) as n_a,
  (select count(*) from predictions where model = b.model) as n_b,
  count(*) as n_both,
  count(*) filter (a.pred_label = a.true_label and b.pred_label = b.true_label) as both_right,
  count(*) filter (a.pred_label = a.true_label and b.pred_label <> b.true_label) as only_a,
  count(*) filter (a.pred_label <> a.true_label and b.pred_label = b.true_label) as only_b,
  count(*) filter (a.pred_label <> a.true_label and b.pred_label <> b.true_label) as both_wrong,
  round(avg((a.pred_label = b.pred_label)::int::double), 6) as agreement
from predictions a join predictions b using (row_id)
where (a.model, b.model) in (('tuned', 'few'), ('tuned', 'zero'), ('few', 'zero'))
group by a.model, b.model"""
    ),
    # aggregations
    "class_counts": sql(
        f"""select label_id, label_list.label, count(d.row_id) as n
from label_list left join (select row_id, coalesce({LABEL_ID}, 0) as label_id from dirty) d using (label_id) group by all"""
    ),
    "class_distribution": sql(
        """select label, """
        + ", ".join(
            f"count(*) filter ({c}) as n_{s}, round(100.0::double * count(*) filter ({c}) / sum(count(*) filter ({c})) over (), 4) as pct_{s}"
            for s, c in [("train", "split = 'train'"), ("val", "split = 'val'"), ("test", "split = 'test'"), ("all", "true")]
        )
        + " from labelled group by label"
    ),
    "class_weights": sql(
        """select label_id, label, n,
  case when n > 0 then round((select count(*) from train)::double / (6 * n), 6) else 0 end as weight from class_counts""",
        CLASS_COUNTS,
    ),
    "sampling_weights": sql(
        "select label_id, label, n, round(1.0::double / (n + 0.000001::double), 6) as weight from class_counts", CLASS_COUNTS
    ),
    "confusion_matrix": sql("select model, true_label, pred_label, count(*) as n from predictions group by all"),
    "confusion_matrix_wide": sql(
        "select model, true_label, "
        + ", ".join(f"count(*) filter (pred_label = '{label}') as pred_{label}" for label in LABELS)
        + f", count(*) filter (pred_label not in ({LABEL_IN})) as pred_other from predictions group by all"
    ),
    "accuracy": sql("select model, round(accuracy, 6) as accuracy from rights", per_class()),
    "per_class_metrics": sql(
        """select model, label_id, label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support
from per_class""",
        per_class(),
    ),
    "macro_f1": sql("select model, round(macro_f1, 6) as macro_f1 from summary", per_class()),
    "observed_metrics": sql(
        """select model, label, round(coalesce(tp / nullif(predicted, 0), 0), 6) as precision, round(coalesce(tp / nullif(support, 0), 0), 6) as recall,
  round(2 * tp / (support + predicted), 6) as f1, support::bigint as support, predicted::bigint as predicted
from (
  select model, label, count(*) filter (side = 't') as support, count(*) filter (side = 'p') as predicted,
    count(*) filter (side = 't' and hit) as tp
  from (
    select model, true_label as label, 't' as side, true_label = pred_label as hit from predictions
    union all select model, pred_label, 'p', false from predictions
  ) group by model, label
)"""
    ),
    "macro_f1_observed": sql(
        "select model, count(*) as n_labels, round(avg(f1), 6) as macro_f1_observed from per_class where support + predicted > 0 group by model",
        per_class(),
    ),
    "micro_f1": sql("select model, round(micro_f1, 6) as micro_f1 from summary", per_class(LABELS[:-1])),
    "weighted_f1": sql("select model, round(weighted_f1, 6) as weighted_f1 from summary", per_class()),
    "metrics_summary": sql(
        """select model, n, round(accuracy, 6) as accuracy, round(macro_f1, 6) as macro_f1, round(micro_f1, 6) as micro_f1,
  round(weighted_f1, 6) as weighted_f1 from summary""",
        per_class(),
    ),
    "classification_report": report(),
    "classification_report_partial": report(LABELS[:-1]),
    "evaluate_predictions": sql(
        "select model, round(macro_f1, 6) as macro_f1, round(accuracy, 6) as accuracy from summary", per_class()
    ),
    "compare_models": sql(
        "select rank, model, round(macro_f1, 6) as macro_f1, round(accuracy, 6) as accuracy, n from ranked", per_class(), RANKED
    ),
    "model_improvement": sql(
        """select c.model as candidate, b.model as baseline, round(c.macro_f1, 4) as candidate_f1,
  round(b.macro_f1, 4) as baseline_f1, round(100.0::double * (c.macro_f1 - b.macro_f1), 4) as points,
  case when b.macro_f1 > 0 then round(c.macro_f1 / b.macro_f1, 4) end as ratio
from (select * from ranked where rank = 1) c
  join (select 1 as best, model, macro_f1 from ranked where rank > 1 union all select 1, 'random guess', 1.0::double / 6) b
  on c.rank = b.best""",
        per_class(),
        RANKED,
    ),
    "all_improvements": sql(
        """select b.model as better, w.model as worse, round(b.macro_f1, 4) as better_f1, round(w.macro_f1, 4) as worse_f1,
  round(100.0::double * (b.macro_f1 - w.macro_f1), 4) as points,
  case when w.macro_f1 > 0 then round(b.macro_f1 / w.macro_f1, 4) end as ratio
from ranked b join (select rank, model, macro_f1 from ranked union all select 1000, 'random guess', 1.0::double / 6) w on w.rank > b.rank""",
        per_class(),
        RANKED,
    ),
    "mean_loss": sql("select count(*) as n, round(avg(factor * ce), 6) as mean_loss from losses", SCORED),
    "weighted_mean_loss": sql(
        """select count(*) as n, round(sum(w * ce) / sum(w), 6) as weighted_mean_loss
from losses join (select y, (select count(*) from logits)::double / (6 * count(*)) as w from logits group by y) using (y)""",
        SCORED,
    ),
    "epoch_loss": sql(
        "select run_id, epoch, count(*) as n_batches, round(avg(loss), 6) as mean_loss from batch_log group by all"
    ),
    "token_vocabulary": sql("select token, token_id, n from vocabulary", vocabulary("labelled")),
    # windows
    "running_epoch_loss": sql(
        """select run_id, epoch, batch, loss, round(avg(loss) over (partition by run_id, epoch order by batch
  rows between unbounded preceding and current row), 6) as running_loss from batch_log"""
    ),
    "best_epoch": sql(
        """select run_id, count(*) as n_epochs, min(epoch) filter (val_f1 = best and best > 0) as best_epoch,
  max(val_f1) filter (val_f1 > 0) as best_f1
from (select *, max(val_f1) over (partition by run_id) as best from epoch_log) group by run_id"""
    ),
    "early_stop": sql(
        """select run_id, max(epoch) as stop_epoch, max(epoch) filter (improves) as best_epoch,
  coalesce(max(val_f1) filter (improves), 0) as best_f1, bool_or(waited >= 2) as stopped_early
from (select *, min(case when waited >= 2 then epoch end) over (partition by run_id) as stop from waits)
where stop is null or epoch <= stop group by run_id""",
        """
improvements as (
  select *, val_f1 > greatest(0.0::double, coalesce(max(val_f1) over (partition by run_id order by epoch
    rows between unbounded preceding and 1 preceding), 0)) as improves from epoch_log),
waits as (
  select *, epoch - coalesce(max(case when improves then epoch end) over (partition by run_id order by epoch), 0) as waited
  from improvements)""",
    ),
    "key_tokens": sql(
        """select label, rank, token, n, score from (
  select *, row_number() over (partition by label order by score desc, token) as rank from scores)
where rank <= 10""",
        f"""
token_counts as (select label, token, count(*) as n from {tokens_of("(select lang as label, text from labelled)", "label")} group by all),
in_label as (select label, sum(n) as label_total from token_counts group by label),
by_token as (select token, sum(n) as n_all from token_counts group by token),
totals as (select *, sum(label_total) over () as all_total from in_label),
scores as (
  select label, token, n, round(ln((n + 1.0::double) / (label_total - n + 1.0::double))
    - ln((n_all - n + 1.0::double) / (all_total - label_total - (n_all - n) + 1.0::double)), 6) as score
  from token_counts join totals using (label) join by_token using (token))""",
    ),
    # sort, limit, sets, sampling
    "row_ordinal": "select doc_id, row_number() over (order by doc_id) - 1 as ordinal from documents",
    "row_ordinal_by_key": """select event_id, user_id, row_number() over (partition by user_id order by event_id) - 1 as ordinal
from events""",
    "first_n": sql("select row_id, text, label from labelled order by row_id limit 100"),
    "first_n_all": sql("select row_id, label from labelled"),
    "label_union": sql("select distinct label from dirty"),
    "unseen_labels": sql(f"select distinct label from dirty where label not in ({LABEL_IN})"),
    "label_mapping": sql(
        """select row_number() over (order by label) - 1 as label_id, label
from (select distinct label from dirty where split = 'train')"""
    ),
    "resolve_labels": sql(
        f"""select label_id, label, 'listed' as mapping from label_list
where not exists (select 1 from dirty where label not in ({LABEL_IN}))
union all select row_number() over (order by label) - 1, label, 'derived'
from (select distinct label from dirty where split = 'train') where exists (select 1 from dirty where label not in ({LABEL_IN}))"""
    ),
    "resolve_labels_listed": sql(
        f"""select label_id, label, 'listed' as mapping from label_list
where not exists (select 1 from labelled where label not in ({LABEL_IN}))
union all select row_number() over (order by label) - 1, label, 'derived'
from (select distinct label from labelled where split = 'train') where exists (select 1 from labelled where label not in ({LABEL_IN}))"""
    ),
    "shuffle_rows": sql("select md5('42:' || row_id) as sort_key, row_id, text, label from train order by sort_key, row_id"),
    "weighted_sample": sql(
        """select draw_id, picked.label_id, row_id
from picked join classes using (label_id)
  join placed on placed.label_id = picked.label_id and position = least(floor(u_row * n)::bigint, n - 1)""",
        CLASS_COUNTS,
        SAMPLE,
    ),
    # baselines and prompted models
    "baseline_predictions": sql(
        f"""select 'majority' as model, row_id, label as true_label,
  (select label from class_counts order by n desc, label_id limit 1) as pred_label from labelled where split = 'test'
union all select 'uniform', row_id, label, {label_name(uniform("md5('42:uniform:' || row_id)", 1, 8) + " % 6")}
from labelled where split = 'test'""",
        CLASS_COUNTS,
    ),
    "generate": sql("select row_id, raw_output from generated", GENERATED),
    "prompted_predictions": sql(
        """select model, row_id, substr(text, 1, 200) as text, true_label, pred_label,
  substr(raw_output, 1, 100) as raw_output from stub""",
        GENERATED,
        STUB_PREDICTIONS.replace("predictions as", "stub as", 1),
    ),
}

# the report of the stub's predictions: the same report, over another prediction table
_STUB = STUB_PREDICTIONS.replace("predictions as", "stub as", 1)
ORACLES["prompted_evaluation"] = report().replace(per_class(), f"{GENERATED},\n{_STUB},\n" + per_class().replace("from predictions", "from stub"))

# the prompted run where the data have a label that is not listed: true labels by the
# vocabulary of the train split, prompts and parsing by the list
_TRUE = """case when coalesce(label, 'nan') in (select coalesce(label, 'nan') from dirty where split = 'train')
  then coalesce(label, 'nan') else (select min(coalesce(label, 'nan')) from dirty where split = 'train') end"""
_GENERATED_DIRTY = GENERATED.replace("from labelled)", "from dirty)")
_STUB_DIRTY = _STUB.replace("row_id, text, label as true_label", f"row_id, coalesce(text, 'nan') as text, {_TRUE} as true_label")
_OF_STUB = """select model, row_id, substr(text, 1, 200) as text, true_label, pred_label,
  substr(raw_output, 1, 100) as raw_output from stub"""
ORACLES["prompted_predictions_unlisted"] = sql(_OF_STUB, _GENERATED_DIRTY, _STUB_DIRTY)
ORACLES["prompted_evaluation_unlisted"] = report().replace(
    per_class(), f"{_GENERATED_DIRTY},\n{_STUB_DIRTY},\n" + per_class().replace("from predictions", "from stub")
)
CONTINUATIONS = ["joy\n\nLyric: x\nEmotion: anger", "SADNESS", "no idea", "Emotion: love"]
_CONTINUED = _STUB.replace(response("raw_output"), "raw_output")
_ONLY_ANSWERS = GENERATED.replace("prompt || " + ANSWER_LIST + f"[length(prompt) % {len(ANSWERS)} + 1]", "[" + ", ".join(text(a) for a in CONTINUATIONS) + f"][length(prompt) % {len(CONTINUATIONS)} + 1]")
ORACLES["prompted_predictions_continued"] = sql(_OF_STUB, _ONLY_ANSWERS, _CONTINUED)
ORACLES["baseline_predictions_unlisted"] = sql(
    f"""select 'majority' as model, row_id, {_TRUE} as true_label, (
  select name from (select {_TRUE} as name from dirty where split = 'train') group by name order by count(*) desc, name limit 1) as pred_label
from dirty where split = 'test'
union all select 'uniform', row_id, {_TRUE}, (
  select list(distinct coalesce(label, 'nan') order by coalesce(label, 'nan')) from dirty where split = 'train')[
    {uniform("md5('42:uniform:' || row_id)", 1, 8)} % (select count(distinct coalesce(label, 'nan')) from dirty where split = 'train') + 1]
from dirty where split = 'test'"""
)

# a model read back predicts as the one that was saved; SQL cannot say what a model has learned
ORACLES["save_model"] = sql("select count(*) as n, 0::bigint as n_differing from labelled where split = 'test'")
ORACLES["generate_stored"] = ORACLES["generate"]
