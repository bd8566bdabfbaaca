"""Validation of submitted responses: every deviation as a row with its code, trial metadata, and a report of counts.

Submissions hold lists and maps as JSON cells. One scan flattens them (operators/nested); the checks are joins, windows
and conditional columns over the flat tables. Lists of one submission (assigned songs, episodes, label orders) are
gathered per submission or trial, which bounds them.

Defined results: a cell that is null or blank is `missing_json` where required, one that is no strict JSON
`malformed_json`; a submission whose responses are no list gives that issue and no responses; responses that are no
objects give an issue and are left out; episode and scenario fill in for each other, as do the two comment fields; an
order or mapping that is absent is not compared; trial numbers that are no integers sort last; a JSON true or false is
no rating; repeated submissions give their issues again; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonelake.functions.text import is_blank
from tonelake.operators import nested
from tonelake.operators.nested import ITEMS, KEYS, Ancestor

#: Sort position of numbers that cannot be read.
LAST = 999_999
_FIELDS = ("trial_index", "episode_id", "scenario_id", "episode_position", "song_id", "excerpt_id", "song_position", "display_label", "display_position", "actual_mix_id", "stimulus_id", "rating", "comment", "comparative_comment", "response_time_ms")
_REQUIRED = ("episode_id", "song_id", "display_label", "stimulus_id", "rating", "comparative_comment")
_ROOT = {c: Ancestor(f"root_{c}", (), (), foreign=True) for c in ("responses_json", "client_validation_json", "assigned_song_ids_json", "episode_order_json", "mix_mapping_json", "presentation_order_json")}
_CELLS = {
    "responses_json": [_ROOT["responses_json"], Ancestor("responses", (ITEMS,), _FIELDS, kinds=("rating",), foreign=True)],
    "client_validation_json": [_ROOT["client_validation_json"], Ancestor("client", (), ("expected_response_count", "actual_response_count"), kinds=("expected_response_count", "actual_response_count"))],
    "assigned_song_ids_json": [_ROOT["assigned_song_ids_json"], Ancestor("assigned", (ITEMS,), (), scalar="value")],
    "episode_order_json": [_ROOT["episode_order_json"], Ancestor("episodes", (ITEMS,), (), scalar="value")],
    "mix_mapping_json": [_ROOT["mix_mapping_json"], Ancestor("mapped_episodes", (KEYS,), (), foreign=True), Ancestor("mapping", (KEYS, KEYS, KEYS), ("stimulus_id",), scalar="stimulus_id")],
    "presentation_order_json": [_ROOT["presentation_order_json"], Ancestor("order", (KEYS, KEYS, ITEMS), (), scalar="label")],
}
#: leaves that only scalars fill are columns too
_CELLS = {c: [Ancestor(a.name, a.steps, (*a.leaves, *([a.scalar] if a.scalar and a.scalar not in a.leaves else [])), a.scalar, a.branches, a.kinds, a.foreign) for a in ancestors] for c, ancestors in _CELLS.items()}


def filled(a: Column, b: Column) -> Column:
    """`a`, or `b` where `a` is blank; never null."""
    return F.coalesce(F.when(~is_blank(a), a), F.when(~is_blank(b), b), F.lit(""))


def position(c: Column) -> Column:
    """An integer to sort by; what is none sorts last."""
    return F.coalesce(c.try_cast("int"), F.lit(LAST))


def is_completed(status: Column, completed_at: Column, responses: Column) -> Column:
    """Whether a submission is complete: by its status, or because it has an end and responses."""
    return F.lower(F.trim(F.coalesce(status, F.lit("")))).isin("completed", "local_only_completed") | (completed_at.isNotNull() & ~is_blank(responses))


def privacy_columns(columns: list[str]) -> list[str]:
    """Columns whose name tells an address or a user agent."""
    return [c for c in columns if c.lower() == "ip" or c.lower().startswith("ip_") or c.lower().endswith("_ip") or "user_agent" in c.lower() or "useragent" in c.lower()]


def json_columns(df: DataFrame, known: tuple[str, ...] = (), sample: int = 5) -> list[str]:
    """Text columns that hold JSON: known ones, those named `_json`, or those whose first non-blank values begin like a list or map."""
    texts = [c for c, t in df.dtypes if t == "string"]
    named = [c for c in texts if c in known or c.endswith("_json")]
    unsure = [c for c in texts if c not in named]
    if not unsure:
        return named
    # the first few values of each column, whatever the table's size
    heads = reduce(DataFrame.unionByName, (df.where(~is_blank(F.col(c))).select(F.lit(c).alias("c"), F.ltrim(F.col(c)).substr(1, 1).alias("v")).limit(sample) for c in unsure))
    like = {r["c"] for r in heads.groupBy("c").agg(F.every(F.col("v").isin("[", "{")).alias("j")).where("j").collect()}
    return [c for c in texts if c in named or c in like]


class Submissions:
    """The flat tables of a table of submissions."""

    def __init__(self, df: DataFrame, row_id: str = "submission_row_id", study: str = "study_id"):
        self.rows = df.select(F.col(row_id).cast("bigint").alias("row_id"), F.coalesce(F.col(study), F.lit("")).alias("study_id"), *(c for c in df.columns if c not in (row_id, study)))
        cells = {c: a for c, a in _CELLS.items() if c in df.columns}
        self.cells = list(cells)
        self.tables = nested.flatten(df, row_id, cells)
        t = self.tables["responses"]
        leaf = lambda c: F.coalesce(F.col(f"leaf_{c}"), F.lit(""))
        plain = [c for c in _FIELDS if c not in ("episode_id", "scenario_id", "comment", "comparative_comment", "rating")]
        self.responses = t.where("leaf_foreign is null").select(
            "row_id", (F.col("ordinal").cast("int") + 1).alias("n"), *(leaf(c).alias(c) for c in plain), filled(F.col("leaf_episode_id"), F.col("leaf_scenario_id")).alias("episode_id"), filled(F.col("leaf_scenario_id"), F.col("leaf_episode_id")).alias("scenario_id"),
            F.coalesce("leaf_comparative_comment", "leaf_comment", F.lit("")).alias("comparative_comment"), F.col("leaf_rating").alias("rating"), F.col("leaf_rating_kind").alias("rating_kind"),
        )

    def _lists(self, name: str, value: Column, by: list[Column] | None = None) -> DataFrame:
        keys = [F.col("row_id"), *(by or [])]
        return self.tables[name].where(value.isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("steps")[F.size("steps") - 1].try_cast("int").alias("at"), value.alias("v")))).alias("_o")).withColumn("list", F.transform("_o", lambda x: x["v"])).drop("_o")

    def valid_episodes(self) -> DataFrame:
        """(row_id, episodes): the episodes that a submission's order or mapping names."""
        named = self.tables["episodes"].select("row_id", F.col("leaf_value").alias("e")).unionByName(self.tables["mapped_episodes"].select("row_id", F.col("steps")[0].alias("e")))
        return named.where("e is not null").groupBy("row_id").agg(F.collect_set("e").alias("episodes"))

    def mapping(self) -> DataFrame:
        """(row_id, episode_id, song_id, display_label, mapped): the stimulus each label stands for; a blank one is none."""
        m = self.tables["mapping"]
        return m.select("row_id", F.col("steps")[0].alias("episode_id"), F.col("steps")[1].alias("song_id"), F.col("steps")[2].alias("display_label"), F.when(~is_blank(F.col("leaf_stimulus_id")), F.col("leaf_stimulus_id")).alias("mapped"))

    # issues: (row_id, place, field, code)

    def cell_issues(self) -> DataFrame:
        out = []
        for c in self.cells:
            root = self.tables[f"root_{c}"].select("row_id", F.coalesce("leaf_foreign", F.lit("map")).alias("kind")).distinct()
            kind = self.rows.select("row_id", F.col(c).alias("cell")).join(root, "row_id", "left")
            if c == "responses_json":
                code = F.when(is_blank(F.col("cell")), "missing_json").when(F.col("kind").isNull(), "malformed_json")
                out.append(kind.where(F.coalesce("kind", F.lit("")) != "list").select("row_id", F.lit("").alias("place"), F.lit(c).alias("field"), F.lit("responses_not_list").alias("code")))
            else:
                code = F.when(~is_blank(F.col("cell")) & F.col("kind").isNull(), "malformed_json")
            out.append(kind.select("row_id", F.lit("").alias("place"), F.lit(c).alias("field"), code.alias("code")).where("code is not null"))
        return reduce(DataFrame.unionByName, out)

    def row_issues(self) -> DataFrame:
        named = self.rows.where("study_id <> ''")
        repeated = named.groupBy("study_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        return (
            self.rows.where("study_id = ''").select("row_id", F.lit("").alias("place"), F.lit("study_id").alias("field"), F.lit("missing_study_id").alias("code"))
            .unionByName(named.join(repeated, "study_id", "left_semi").select("row_id", F.lit("").alias("place"), F.lit("study_id").alias("field"), F.lit("duplicate_study_id").alias("code")))
        )

    def count_issues(self, count_column: str | None = None) -> DataFrame:
        """Counts that the client states against the responses that came."""
        whole = lambda c: F.when(F.col(f"leaf_{c}_kind") == "number", F.col(f"leaf_{c}").try_cast("bigint"))
        came = self.tables["root_responses_json"].where("leaf_foreign = 'list'").select("row_id").distinct().join(self.tables["responses"].groupBy("row_id").agg(F.count(F.lit(1)).alias("came")), "row_id", "left").select("row_id", F.coalesce("came", F.lit(0)).alias("came"))
        stated = came.join(self.tables["client"].select("row_id", whole("expected_response_count").alias("expected"), whole("actual_response_count").alias("actual")).distinct(), "row_id", "left")
        columns = {"client_validation_json": [("expected_actual_mismatch", F.col("actual") != F.col("came")), ("expected_actual_mismatch", F.col("expected") != F.col("actual"))]}
        if count_column:
            stated = stated.join(self.rows.select("row_id", F.col(count_column).cast("string").alias("_c")), "row_id")
            columns[count_column] = [("response_count_mismatch", F.col("_c").rlike("^[0-9]+$") & (F.col("_c").try_cast("bigint") != F.col("came")))]
        return _issues(stated.select("*", F.lit("").alias("place")), [(f, code, cond) for f, rules in columns.items() for code, cond in rules])

    def checked_responses(self) -> DataFrame:
        """Responses with what their submission assigns, maps and repeats."""
        r = self.responses
        seen = F.row_number().over(W.partitionBy("row_id", "trial_index", "episode_id", "song_id", "display_label").orderBy("n"))
        return (
            r.withColumn("repeat", seen)
            .join(self._lists("assigned", F.col("leaf_value")).withColumnRenamed("list", "assigned"), "row_id", "left")
            .join(self.valid_episodes(), "row_id", "left")
            .join(self.mapping(), ["row_id", "episode_id", "song_id", "display_label"], "left")
        )

    def response_issues(self) -> DataFrame:
        foreign = self.tables["responses"].where("leaf_foreign is not null").select("row_id", (F.col("ordinal").cast("int") + 1).cast("string").alias("place"), F.lit("responses_json").alias("field"), F.lit("response_not_object").alias("code"))
        rules = [*_field_rules(_REQUIRED), ("rating", "rating_not_integer_0_100", ~whole_rating(F.col("rating"), F.col("rating_kind")))]
        rules += [
            ("song_id", "unassigned_song_id", (F.size("assigned") > 0) & ~F.array_contains("assigned", F.col("song_id"))),
            ("episode_id", "invalid_episode_id", (F.size("episodes") > 0) & ~F.array_contains("episodes", F.col("episode_id"))),
            ("display_label", "missing_mix_mapping", F.col("mapped").isNull()),
            ("stimulus_id", "mapping_response_disagreement", F.col("mapped").isNotNull() & (F.col("stimulus_id") != "") & (F.col("mapped") != F.col("stimulus_id"))),
            ("responses_json", "duplicate_response_within_trial", F.col("repeat") > 1),
        ]
        return _issues(self.checked_responses().withColumn("place", F.col("n").cast("string")), rules).unionByName(foreign)

    def trials(self) -> DataFrame:
        """One row per trial: labels, stimuli and mixes in display order, comments, and what does not agree."""
        t = trials(self.responses, ["row_id"])
        orders = self._lists("order", F.col("leaf_label"), [F.col("steps")[0].alias("episode_id"), F.col("steps")[1].alias("song_id")]).withColumnRenamed("list", "exported_order")
        labels = self.mapping().groupBy("row_id", "episode_id", "song_id").agg(F.array_sort(F.collect_set("display_label")).alias("mapping_labels"))
        out = t.join(orders, ["row_id", "episode_id", "song_id"], "left").join(labels, ["row_id", "episode_id", "song_id"], "left")
        differs = (F.size("exported_order") > 0) & (F.col("exported_order") != F.col("labels"))
        unexpected = (F.size("mapping_labels") > 0) & (F.col("mapping_labels") != F.array_sort(F.array_distinct("labels")))
        return _noted(out, [("display order differs from presentation_order_json", differs), ("mapping labels differ from response labels", unexpected)]).withColumn("order_differs", F.coalesce(differs, F.lit(False))).withColumn("labels_differ", F.coalesce(unexpected, F.lit(False)))

    def trial_issues(self) -> DataFrame:
        t = self.trials().withColumn("place", F.concat(F.lit("trial_"), "trial_index"))
        return _issues(t, [("presentation_order_json", "presentation_order_disagreement", F.col("order_differs")), ("mix_mapping_json", "unexpected_mix_count", F.col("labels_differ")), ("comparative_comment", "inconsistent_trial_comments", F.size("comments") != 1)])

    def issues(self, count_column: str | None = None) -> DataFrame:
        """All issues: (row_id, place, field, code)."""
        return reduce(DataFrame.unionByName, (self.row_issues(), self.cell_issues(), self.count_issues(count_column), self.response_issues(), self.trial_issues()))


def whole_rating(rating: Column, kind: Column | None = None) -> Column:
    """Whether a rating is an integer from 0 to 100; with its JSON kind, only numbers are."""
    ok = F.coalesce(rating, F.lit("")).rlike("^-?[0-9]{1,9}$") & F.coalesce(rating.try_cast("int").between(0, 100), F.lit(False))
    return ok if kind is None else ok & F.coalesce(kind == "number", F.lit(False))


def _field_rules(fields: tuple[str, ...]) -> list[tuple[str, str, Column]]:
    return [(f, "missing_stimulus_id" if f == "stimulus_id" else "missing_response_field", F.coalesce(F.col(f), F.lit("")) == "") for f in fields]


def _issues(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(row_id, place, field, code): one row per rule that holds, in one pass."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(code).alias("code"))) for f, code, c in rules)))
    return df.select("row_id", "place", F.inline(found))


def trials(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Trials of flat responses, gathered in display order; each trial holds the few versions that were shown."""
    one = F.struct(position(F.col("display_position")).alias("p"), F.col("display_label").alias("label"), F.col("n"), F.col("stimulus_id").alias("stimulus"), F.col("actual_mix_id").alias("mix"))
    got = responses.groupBy(*keys, "trial_index", "episode_id", "song_id").agg(F.array_sort(F.collect_list(one)).alias("o"), F.array_sort(F.collect_set(F.when(~is_blank(F.col("comparative_comment")), F.col("comparative_comment")))).alias("comments"))
    part = lambda c: F.transform("o", lambda x: x[c])
    return got.select(*keys, "trial_index", "episode_id", "song_id", position(F.col("trial_index")).alias("trial_position"), F.size("o").alias("displayed"), part("label").alias("labels"), part("stimulus").alias("stimuli"), part("mix").alias("mixes"), "comments")


def _noted(t: DataFrame, more: list[tuple[str, Column]]) -> DataFrame:
    """Adds `notes` and `status` (valid or invalid) of each trial."""
    notes = [*more, ("duplicate display label", F.size(F.array_distinct("labels")) < F.size("labels")), ("duplicate stimulus_id", F.size(F.array_distinct("stimuli")) < F.size("stimuli")), ("missing stimulus_id", F.array_contains("stimuli", "")), ("inconsistent or missing trial comments", F.size("comments") != 1)]
    text = F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in notes))), " | ")
    return t.withColumn("notes", text).withColumn("status", F.when(text == "", "valid").otherwise("invalid"))


def long_issues(df: DataFrame, row_id: str) -> DataFrame:
    """The issues of responses that are flat already: (row_id, place, field, code). Orders and mappings cannot be checked, which each study's first row tells.

    `place` is empty. Ratings are text there, so their digits decide; trials are those of a study.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    r = df.select(F.col(row_id).cast("bigint").alias("row_id"), F.lit("").alias("place"), *(text(c).alias(c) for c in ("study_id", "trial_index", "song_id", "display_label", "stimulus_id", "comparative_comment")), filled(F.col("episode_id"), F.col("scenario_id")).alias("episode_id"), F.col("rating").cast("string").alias("rating"))
    repeat = F.row_number().over(W.partitionBy("study_id", "trial_index", "episode_id", "song_id", "display_label").orderBy("row_id"))
    found = _issues(r.withColumn("repeat", repeat), [*_field_rules(_REQUIRED), ("rating", "rating_not_integer_0_100", ~whole_rating(F.col("rating"))), ("responses_json", "duplicate_response_within_trial", F.col("repeat") > 1)])
    first = r.groupBy("study_id").agg(F.min("row_id").alias("row_id")).select("row_id", F.lit("").alias("place"), F.lit("responses_json").alias("field"), F.lit("raw_json_unavailable").alias("code"))
    return found.unionByName(first)


def numeric_rating_issues(responses: DataFrame) -> DataFrame:
    """The older export's only rating rule: a rating must be a JSON number."""
    return _issues(responses.withColumn("place", F.col("n").cast("string")), [("rating", "rating_not_numeric", F.coalesce(F.col("rating_kind"), F.lit("")) != "number")])


def report(s: Submissions, issues: DataFrame, completed: Column) -> DataFrame:
    """(name, value): the counts of a conversion, every issue code among them, and whether it passes."""
    rows = s.rows.agg(F.count(F.lit(1)).alias("submissions"), F.count_distinct(F.nullif("study_id", F.lit(""))).alias("unique_study_ids"), F.count_if(completed).alias("completed_submissions"))
    out = rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in rows.columns))))
    counts = issues.groupBy(F.concat(F.lit("issues_"), "code").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    totals = s.responses.agg(F.count(F.lit(1)).alias("value")).select(F.lit("responses").alias("name"), "value").unionByName(s.trials().agg(F.count(F.lit(1)).alias("value")).select(F.lit("trials").alias("name"), "value"))
    passed = issues.agg((F.count(F.lit(1)) == 0).cast("bigint").alias("value")).select(F.lit("passed").alias("name"), "value")
    return reduce(DataFrame.unionByName, (out, totals, counts, passed))
