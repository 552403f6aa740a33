"""The data sides of model-based reduction: prompts out, responses in.  The model call itself is another job."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge import fixed_values as fv
from corpusforge.functions.paths import basename
from corpusforge.functions.text import bind, is_blank, json_value, strip, utf8_size
from corpusforge.operators.reduce import PREFIXES, ROUTES, measured, reduce_routed, smart_route, typed

KEYS = ["corpus_id", "path"]


def prompt_table(files: DataFrame, model: str, max_tokens: int = 2000, temperature: float = 0.1,
                 limit: int = fv.PROMPT_MAX_CHARS) -> DataFrame:
    """corpus_id, path, content_sha256, model, max_tokens, temperature, prompt; blank files have no prompt."""
    content = F.when(F.length("content") > limit, F.concat(
        F.left("content", F.lit(limit)), F.lit("\n... (content truncated for brevity) ..."))).otherwise(F.col("content"))
    rows = (typed(files.filter(~is_blank(F.col("content"))))
            .withColumn("content_sha256", F.sha2("content", 256)).withColumn("content", content))
    keys = ", ".join(fv.RESPONSE_KEYS)
    parts = ", ".join(fv.COMPONENT_LIST_KEYS + fv.COMPONENT_TEXT_KEYS)
    prompt = F.concat(
        F.lit("Summarise one source file as a JSON object that lets a developer rebuild it.\n\nPath: "), F.col("path"),
        F.lit("\nType: "), F.col("file_type"), F.lit("\nBytes: "), utf8_size(F.col("content")).cast("string"),
        F.lit("\n\n<<<FILE\n"), F.col("content"), F.lit("\nFILE>>>\n\n"),
        F.lit(f"Answer with the JSON object only. Keys: {keys}, critical_reconstruction_details, "
              f"external_interactions. key_components holds: {parts}."))
    return rows.select(*KEYS, "content_sha256", F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"),
                       F.lit(temperature).alias("temperature"), prompt.alias("prompt"))


def _unfenced(raw: Column) -> Column:
    """Inside of a fenced block, when the answer starts with a fence."""

    def inside(fence):
        body = strip(F.substring(raw, len(fence) + 1, 2_000_000_000))
        return F.when(body.endswith("```"), strip(F.regexp_replace(body, r"```\z", ""))).otherwise(body)

    return F.when(raw.startswith("```json"), inside("```json")).when(raw.startswith("```"), inside("```")).otherwise(raw)


def extract_json(raw: Column) -> Column:
    """The JSON text of an answer; null when it holds no '{'."""
    text = _unfenced(strip(raw))
    first = F.locate("{", text)
    last = F.length(text) - F.locate("}", F.reverse(text)) + 1
    cut = F.when((last > first) & text.contains("}"), F.substring(text, first, last - first + 1)).otherwise(text)
    return F.when(text.startswith("{"), text).when(first > 0, cut)


JSON_TOKEN = r'(?s)"(?:[^"\\]++|\\.)*+"|[{}\[\],:]|[^\s{}\[\],:"]++'


def laid_out(json: Column, top: Column, parts: Column) -> Column:
    """JSON text with two-space indentation, keys in their order, and missing entries added at the end.

    ``top`` holds entries for the document, ``parts`` for its key_components object.  A fold over the tokens; answers
    are bounded by the model's output limit, so its text stays small.
    """
    def line(depth):
        return F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))

    def step(state, token):
        opens, closes, fresh = token.isin("{", "["), token.isin("}", "]"), state.prev.isin("{", "[", ",")
        added = F.when((token == "}") & (state.depth == 1), top).when(
            (token == "}") & (state.depth == 2) & (state.key == '"key_components"'), parts).otherwise(
            F.array().cast("array<string>"))

        def closing(entries):
            listed = F.array_join(F.transform(entries, lambda e: F.concat(line(state.depth), e)), ",")
            glue = F.when((F.size(entries) > 0) & ~state.prev.isin("{", "["), ",").otherwise("")
            empty = state.prev.isin("{", "[") & (F.size(entries) == 0)
            return F.concat(glue, listed, F.when(empty, "").otherwise(line(state.depth - 1)), token)

        text = (F.when(closes, bind(added, closing)).when(token == ",", ",").when(token == ":", ": ")
                .when(fresh, F.concat(line(state.depth), token)).otherwise(token))
        key = F.when((state.depth == 1) & fresh & token.startswith('"'), token).otherwise(state.key)
        return F.struct(F.concat(state.out, text).alias("out"),
                        (state.depth + opens.cast("int") - closes.cast("int")).alias("depth"),
                        token.alias("prev"), key.alias("key"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit("").alias("prev"), F.lit("").alias("key"))
    text = F.aggregate(F.regexp_extract_all(json, F.lit(JSON_TOKEN), F.lit(0)), start, step, lambda state: state.out)

    def escaped(char):
        units = F.regexp_replace(F.lower(F.hex(F.encode(char, "UTF-16BE"))), "(.{4})", r"\\u$1")
        return F.when(F.ascii(char) > 127, units).otherwise(char)

    return bind(text, lambda t: F.when(t.rlike(r"[^\x00-\x7f]"), F.array_join(
        F.transform(F.split(t, ""), escaped), "")).otherwise(t))


def parse_responses(responses: DataFrame) -> DataFrame:
    """(corpus_id, path, file_type, raw_text, ...) plus ``record`` (variant, or null when the answer is not usable).

    ``record_json`` is the answer laid out with defaults for missing keys, as text; ``n_missing_keys`` counts those.
    """
    rows = responses.withColumn("answer", extract_json(F.col("raw_text")))
    parsed = json_value(F.col("answer"))
    rows = rows.withColumn("record", F.when(F.schema_of_variant(parsed).startswith("OBJECT<"), parsed))

    def has(path):
        return F.try_variant_get("record", path, "variant").isNotNull()

    def entry(key, default):
        return F.concat(F.lit(f'"{key}": '), default)

    path = F.regexp_extract(F.to_json(F.struct(F.col("path").alias("v"))), r'(?s)^\{"v":(.*)\}\z', 1)
    inner = [(k, F.lit("[]")) for k in fv.COMPONENT_LIST_KEYS] + [(k, F.lit('""')) for k in fv.COMPONENT_TEXT_KEYS]
    whole = F.concat(F.lit("{\n    "), F.concat_ws(",\n    ", *[entry(k, d) for k, d in inner]), F.lit("\n  }"))
    defaults = {"file_path": path, "file_type": path, "overall_purpose": F.lit('""'), "key_components": whole,
                "core_logic_flow": F.lit('""')}
    is_object = F.schema_of_variant(F.try_variant_get("record", "$.key_components", "variant")).startswith("OBJECT<")
    top = F.array_compact(F.array(*[F.when(~has(f"$.{k}"), entry(k, defaults[k])) for k in fv.RESPONSE_KEYS]))
    parts = F.array_compact(F.array(*[
        F.when(is_object & ~has(f"$.key_components.{k}"), entry(k, d)) for k, d in inner]))
    return (rows.select("*", top.alias("_top"), parts.alias("_parts"))
            .select("*", F.size("_top").alias("n_missing_keys"), F.when(F.col("record").isNotNull(), laid_out(
                F.col("answer"), F.col("_top"), F.col("_parts"))).alias("record_json"))
            .drop("_top", "_parts", "answer"))


def semantic_text(label: str = fv.SEMANTIC_LABEL) -> Column:
    """The stored form of a usable response: three header lines and the JSON."""
    return F.concat(F.lit(f"# SEMANTIC COMPRESSION v1.1 ({label})\n# Original: "), basename(F.col("path")), F.lit(" ("),
                    F.col("original_size").cast("string"), F.lit(" bytes, "), F.col("file_type"), F.lit(")\n# Model: "),
                    F.col("model"), F.lit("\n"), F.col("record_json"))


def ingest_responses(files: DataFrame, responses: DataFrame, level: str = "semantic") -> DataFrame:
    """Reduced rows of ``level`` semantic or smart, given responses(corpus_id, path, model, raw_text), one per file.

    Semantic: a usable response becomes the text, any other file takes the aggressive level.  Smart: a usable
    response must shrink a code file by more than its ratio, else the size tiers decide.
    """
    parsed = parse_responses(responses).select(*KEYS, "model", "record_json")
    rows = (typed(files.select(*KEYS, "content")).join(parsed, KEYS, "left").withColumn("blank", is_blank(F.col("content")))
            .withColumn("semantic", F.when(F.col("record_json").isNotNull(), semantic_text())))
    size = F.col("original_size")
    if level == "smart":
        code = F.col("file_type").isin(fv.SMART_CODE_TYPES) & (size > fv.SMART_SEMANTIC_MIN_BYTES)
        shrinks = size / F.greatest(F.octet_length("semantic"), F.lit(1)) > fv.SMART_SEMANTIC_MIN_RATIO
        use, other, good, bad = code & shrinks, smart_route(F.col("file_type"), size), "smart->", "smart->"
    else:
        use, other, good, bad = F.lit(True), F.lit("aggressive"), "", PREFIXES["semantic"]
    use = F.coalesce(use & F.col("semantic").isNotNull() & ~F.col("blank"), F.lit(False))
    columns = [*KEYS, "content", "file_type", "original_size"]
    kept = rows.filter(use).select(*columns, F.lit("semantic").alias("route"), F.col("semantic").alias("reduced"),
                                   F.lit(good + fv.METHOD_SEMANTIC).alias("method"))
    rest = rows.filter(~use).select(*columns, F.when(F.col("blank"), "blank").otherwise(other).alias("route"))
    fallen = reduce_routed(rest, ROUTES[level]).withColumn("method", F.when(F.col("route") == "blank", F.col("method"))
                                            .otherwise(F.concat(F.lit(bad), F.col("method"))))
    return (measured(kept.unionByName(fallen)).withColumn("level", F.lit(level))
            .select(*KEYS, "file_type", "level", "method", "reduced", "original_size", "reduced_size", "tokens", "ratio"))


def wrap_envelope(path: Column, size: Column, file_type: Column, description: Column) -> Column:
    return F.concat(F.lit("# SEMANTIC COMPRESSION v1.0\n# Original: "), basename(path), F.lit(" ("), size.cast("string"),
                    F.lit(" bytes, "), file_type, F.lit(")\n"), description, F.lit("\n# END SEMANTIC COMPRESSION"))


def valid_description(description: Column) -> Column:
    """True for a JSON object that has a purpose and components."""
    record = json_value(_unfenced(strip(description)))
    return F.coalesce(F.try_variant_get(record, "$.purpose", "variant").isNotNull()
                      & F.try_variant_get(record, "$.components", "variant").isNotNull(), F.lit(False))


def unwrap_envelope(text: Column) -> Column:
    """Lines between the last origin header before the end marker and that marker; null for any other text."""
    inside = F.regexp_extract(text, r"(?s)\A(.*?)(?:\A|\n)# END SEMANTIC COMPRESSION", 1)
    body = F.regexp_extract(F.concat(F.lit("\n"), inside), r"(?s)\A.*\n# Original:[^\n]*(?:\n(.*))?\z", 1)
    known = text.startswith("# SEMANTIC COMPRESSION") & text.contains("\n# END SEMANTIC COMPRESSION")
    return F.when(known & inside.contains("\n# Original:"), strip(body))
