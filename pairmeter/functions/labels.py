"""Names and labels to fields: ordered patterns as CASE chains, never a UDF."""

from pyspark.sql import Column, functions as F

from pairmeter.functions import vocab


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Both-ends whitespace trim (any whitespace, not only blanks)."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def first_match(text: Column, cases) -> Column:
    """Value of the first pattern found in the text; null if none is."""
    out = None
    for pattern, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(text.rlike(pattern), value) if out is None else out.when(text.rlike(pattern), value)
    return out


def _unstarred(label) -> Column:
    return F.lower(strip(F.regexp_replace(strip(label), r"^\*+|\*+$", "")))


def is_aggregate(label) -> Column:
    return _unstarred(label).rlike(vocab.AGGREGATE_PATTERN)


def canonical_task(label) -> Column:
    """Task name of a table label; null for empty, aggregate and unknown labels."""
    s = F.regexp_replace(F.regexp_replace(_unstarred(label), "[–—]", "-"), r"\|", "")
    known = first_match(s, [(pattern, name) for name, pattern, _ in vocab.TASKS])
    return F.when((s != "") & ~s.rlike(vocab.AGGREGATE_PATTERN), known)


def task_items(task) -> Column:
    t = _c(task)
    items = {**{name: n for name, _, n in vocab.TASKS}, vocab.AMBIGUOUS_TASK: vocab.AMBIGUOUS_ITEMS}
    out = None
    for name, n in items.items():
        out = F.when(t == name, n) if out is None else out.when(t == name, n)
    return out


def treatment(name) -> Column:
    """struct(scheme, weight_bits, act_bits, num_type), null when no token is found."""
    cases = [("(?i)" + pattern, F.struct(F.lit(s).alias("scheme"), F.lit(w).alias("weight_bits"),
                                         F.lit(a).alias("act_bits"), F.lit(t).alias("num_type")))
             for s, pattern, w, a, t in vocab.TREATMENTS]
    return first_match(_c(name), cases)


def params_b(name) -> Column:
    """Size in billions: N x M for expert mixtures, else the first ``<n>B``."""
    n = _c(name)
    num = lambda pattern, i: F.regexp_extract(n, pattern, i).try_cast("double")
    return F.coalesce(num(vocab.MOE_SIZE_PATTERN, 1) * num(vocab.MOE_SIZE_PATTERN, 2), num(vocab.SIZE_PATTERN, 1))


def family(name) -> Column:
    return F.coalesce(first_match(_c(name), [("(?i)" + p, f) for f, p in vocab.FAMILIES]), F.lit("other"))


def cluster_key(name) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(name), "^[^/]*/", ""), "(?i)" + vocab.TREATMENT_SUFFIX, "")


def method(text, scheme) -> Column:
    """Both of the combined pair, else the first listed, else a default by treatment."""
    t, s = _c(text), _c(scheme)
    seen = {name: t.rlike(pattern) for name, pattern in vocab.METHODS}
    chain = F.when(seen["gptq"] & seen["smoothquant"], "smoothquant+gptq")
    for name in ("gptq", "awq", "smoothquant", "rtn"):
        chain = chain.when(seen[name], name)
    return chain.when(s.rlike("^(fp8|nvfp4|mxfp4)"), "rtn").otherwise("unknown")


def is_instruct(name) -> Column:
    return _c(name).rlike(r"(?i)instruct|-it\b|chat").cast("int")
