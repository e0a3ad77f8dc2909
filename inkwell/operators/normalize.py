"""Entity names: aliases, case folding, backfill, resolution, classes and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .qgrams import index_of
from .text import CITATION

ACRONYM = r"\s*\([A-Z][A-Za-z0-9\-]+\)\s*$"

# Names of known entities of each class.
MODELS = [
    "gpt-4", "gpt-3", "gpt-3.5", "gpt-2", "gpt2", "gpt", "claude", "claude 2", "claude 3", "llama", "llama 2", "llama-2", "llama2", "mistral",
    "mixtral", "gemini", "palm", "palm 2", "falcon", "bloom", "opt", "pythia", "alpaca", "vicuna", "orca", "guanaco", "chinchilla", "gopher",
    "sparrow", "codex", "starcoder", "codegeex", "dall-e", "dall·e", "stable diffusion", "midjourney", "imagen", "t5", "flan-t5", "ul2",
    "switch transformer", "roberta", "deberta", "electra", "xlnet", "albert", "bert", "bert-base", "bert-large", "gpt-neo", "gpt-j", "gpt-neox",
    "openllama", "mpt", "dolly", "gorilla", "whisper", "clip", "blip", "blip-2", "flamingo", "llava", "alphallm", "alphacode",
]
FRAMEWORKS = [
    "pytorch", "tensorflow", "jax", "flax", "keras", "hugging face", "huggingface", "transformers library", "deepspeed", "fairseq", "megatron",
    "ray", "ray tune", "optuna", "sklearn", "scikit-learn", "numpy", "scipy", "pandas", "cuda", "triton", "langchain", "llamaindex", "llama index",
    "vllm", "text generation inference", "openai api", "anthropic api",
]
OPTIMIZERS = [
    "adam", "adamw", "sgd", "rmsprop", "adagrad", "adadelta", "adafactor", "lion", "lamb", "lars", "nadam", "radam", "gradient descent",
    "stochastic gradient descent", "momentum", "nesterov", "lbfgs", "bfgs", "sign sgd", "signsgd", "universal stochastic gradient methods",
    "ternary gradients",
]
METRICS = [
    "bleu", "rouge", "meteor", "cider", "perplexity", "accuracy", "f1", "f1 score", "precision", "recall", "pass@k", "pass@1", "human eval",
    "humaneval", "mmlu", "hellaswag", "winogrande", "arc", "exact match", "em score", "win rate", "elo", "fid", "inception score", "clip score",
    "map", "ndcg", "kl divergence", "cross-entropy loss", "cross entropy loss", "reward model score", "truthfulqa score",
]
DATASETS = [
    "imagenet", "coco", "cifar", "cifar-10", "cifar-100", "mnist", "fashion-mnist", "squad", "squad 2.0", "natural questions", "trivia qa", "gsm8k",
    "math", "mathbench", "mmlu", "truthfulqa", "bbh", "big bench", "openwebtext", "the pile", "redpajama", "c4", "alpacaeval", "mt-bench",
    "humaneval", "mbpp", "boolq", "hellaswag", "winogrande", "arc", "commonsense qa", "openai evals", "webgpt comparisons", "laion", "cc3m", "cc12m",
    "vqa", "gqa", "vizwiz", "librispeech",
]
ARCHITECTURE = r"\btransformer\b|\bcnn\b|\blstm\b|\bgru\b|\bmlp\b|\bresnet\b|\bvit\b|\bvae\b|\bgan\b|\bdiffusion model|\bmixture.of.expert|\bmoe\b|\battention mechanism|\bself.attention\b|\bmulti.head attention|\bstate.space model|\bmamba\b|\bencoder.decoder\b|\bautoregressive model|\bflow.based model|\bnormalizing flow|\bgraph neural|\bgnn\b"
ALGORITHM = r"\bmonte carlo\b|\bmcts\b|\bbeam search\b|\bgreedy\b|\bdynamic programming\b|\bviterbi\b|\bexpectation.maximization\b|\bk.means\b|\bedge-deletion\b|\bsorting\b|\btree search\b|\bvalue iteration\b|\bpolicy gradient\b|\bppo\b|\bgrpo\b|\bdpo\b|\brlhf\b|\breinforce\b|\bsinkhorn\b|\boptimal transport\b|\bseed.selection\b|\brecursive value\b"
REST = [
    (r"\b(adam|adamw|sgd|rmsprop|adagrad|optimizer|optimis[ae]r)\b", "Optimizer"),
    (r"\b(llm|language model|chat model|foundation model|large model|pretrained model|pre-trained model)\b", "Model"),
    (r"\b(framework|library|toolkit|platform|package|tool)\b", "Tool"),
    (r"\b(dataset|benchmark|corpus|evaluation set)\b", "Dataset"),
    (r"\b(metric|score|rate|accuracy|precision|recall|f1|bleu|rouge)\b", "Metric"),
    (r"\b(learning|training|fine.tun|pre.train|distill|pruning|quantiz)\b", "Technique"),
]


def classify(name: Column) -> Column:
    """The class of an entity name: known names first, then patterns in order."""
    low = F.lower(F.trim(name))
    out = None
    for known, kind in ((MODELS, "Model"), (FRAMEWORKS, "Framework"), (OPTIMIZERS, "Optimizer"), (METRICS, "Metric"), (DATASETS, "Dataset")):
        test = low.isin(known)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    for pattern, kind in [(ARCHITECTURE, "Architecture"), (ALGORITHM, "Algorithm"), *REST]:
        out = out.when(F.lower(name).rlike(pattern), kind)
    return out.otherwise("Unknown")


def token_set(name: Column, stops: tuple[str, ...] = ("a", "an", "the", "of", "for", "and", "with", "in", "on", "to")) -> Column:
    words = F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(list(stops)))))


def resolve_alias(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Adds ``alias``: by the name without citation marks, else also without its trailing acronym.

    ``aliases`` (key, canonical) is joined twice; Spark broadcasts it if it is small.
    """
    cleaned = F.trim(F.regexp_replace(name, CITATION, ""))
    rows = names.withColumns({"_a": F.lower(cleaned), "_b": F.lower(F.trim(F.regexp_replace(cleaned, ACRONYM, "")))})
    a, b = aliases.toDF("_a", "_ca"), aliases.toDF("_b", "_cb")
    return rows.join(a, "_a", "left").join(b, "_b", "left").withColumn("alias", F.coalesce("_ca", "_cb")).drop("_a", "_b", "_ca", "_cb")


def case_fold(names: DataFrame, name: str = "name", count: str = "n") -> DataFrame:
    """(name, canonical): of spellings that fold together the most frequent, then a capital first, then the smallest."""
    key = F.lower(F.trim(F.regexp_replace(name, ACRONYM, "")))
    rows = names.select(name, count, key.alias("_k"), F.substring(name, 1, 1).rlike(r"\p{Lu}").alias("_u"))
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(F.desc(count), F.desc("_u"), name))).where("_r = 1").select("_k", F.col(name).alias("canonical"))
    return rows.join(best, "_k").select(name, "canonical")


def normalize_all(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, canonical): by alias, and case folding among the rest."""
    rows = resolve_alias(names, aliases)
    done = rows.where("alias is not null").select("name", F.col("alias").alias("canonical"))
    return done.unionByName(case_fold(rows.where("alias is null").select("name", "n")))


def backfill(techniques: DataFrame) -> DataFrame:
    """(paper_id, name, proposed, match_type) for rows without canonical name that match a known one."""
    known = techniques.where("canonical_name is not null").groupBy("canonical_name").agg(F.count_distinct("paper_id").alias("n"))
    lookup = known.groupBy(F.lower("canonical_name").alias("_k")).agg(F.max_by("canonical_name", F.struct(F.col("n"), F.col("canonical_name"))).alias("_c"))
    rows = techniques.where("canonical_name is null and name is not null").select("paper_id", "name")
    rows = rows.join(lookup, F.lower("name") == F.col("_k"))
    return rows.select("paper_id", "name", F.col("_c").alias("proposed"), F.when(F.col("name") == F.col("_c"), "exact").otherwise("case_insensitive").alias("match_type"))


def rare_tokens(rows: DataFrame, key: str, tokens: str, share: float) -> DataFrame:
    """(key, token): of each row the rarest tokens, as many that two rows sharing ``share`` of them must have one in common.

    A set of n that shares at least k = ceil(share * n) tokens with another has one of
    them among its n - k + 1 rarest, so tokens that very many rows have are not joined on.
    """
    each = rows.select(key, F.size(tokens).alias("_n"), F.explode(tokens).alias("token"))
    df = each.groupBy("token").agg(F.count("*").alias("_df"))
    ranked = each.join(df, "token").withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_df", "token")))
    return ranked.where(F.col("_r") <= F.col("_n") - F.ceil(F.round(share * F.col("_n"), 9)) + 1).select(key, "token")


def suspected_duplicates(names: DataFrame, name: str = "name", overlap: float = 0.8, ratio: float = 0.6) -> DataFrame:
    """(a, b, reason): names of which one holds the other, or that share most tokens.

    Both joins are on what such pairs must share: for the overlap one of either's rarest
    tokens, for containment the shorter name's rarest runs of three letters.
    """
    rows = names.select(F.col(name).alias("n")).distinct().select("n", F.lower("n").alias("low"), token_set(F.col("n")).alias("ts"))
    rare = rare_tokens(rows.where(F.size("ts") >= 2), "n", "ts", overlap)
    pairs = rare.toDF("a", "token").join(rare.toDF("b", "token"), "token").where("a < b").select("a", "b").distinct()
    sets = rows.select("n", "ts")
    pairs = pairs.join(sets.toDF("a", "ta"), "a").join(sets.toDF("b", "tb"), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    jac = pairs.where(shared >= overlap * (F.size("ta") + F.size("tb") - shared)).select("a", "b", F.lit("token-overlap").alias("reason"))
    lows = rows.select("n", "low")
    held = index_of(lows, "low").find(lows.select(F.col("low").alias("term")), ratio)
    sub = held.join(lows.toDF("short", "term"), "term").join(lows.toDF("long", "text"), "text")
    sub = sub.select(F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b"), F.lit("substring").alias("reason")).distinct()
    return sub.unionByName(jac.join(sub, ["a", "b"], "left_anti"))


def title_tokens(title: Column) -> Column:
    words = F.filter(F.split(title, r"\s+"), lambda w: F.length(w) > 2)
    return F.array_distinct(F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[.,:\-()\[\]]+|[.,:\-()\[\]]+$", "")))


def match_titles(raw: DataFrame, known: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(raw_id, id, score): for each raw title the known one of most shared tokens over the longer's, if enough.

    The two titles share ``threshold`` of either's tokens, so one of the raw title's
    rarest ones; only those are looked up.
    """
    a = raw.select("raw_id", title_tokens(F.col("title")).alias("ta")).where(F.size("ta") > 0)
    b = known.select("id", title_tokens(F.col("title")).alias("tb")).where(F.size("tb") > 0)
    posts = b.select("id", F.explode("tb").alias("token"))
    df = posts.groupBy("token").agg(F.count("*").alias("_df"))
    each = a.select("raw_id", F.size("ta").alias("_n"), F.explode("ta").alias("token")).join(df, "token", "left")
    ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy("raw_id").orderBy(F.coalesce("_df", F.lit(0)), "token")))
    rare = ranked.where(F.col("_r") <= F.col("_n") - F.ceil(F.round(threshold * F.col("_n"), 9)) + 1)
    pairs = rare.join(posts, "token").select("raw_id", "id").distinct().join(a, "raw_id").join(b, "id")
    score = F.size(F.array_intersect("ta", "tb")) / F.greatest(F.size("ta"), F.size("tb"))
    best = pairs.select("raw_id", "id", score.alias("score")).where(F.col("score") >= threshold)
    best = best.groupBy("raw_id").agg(F.max_by(F.struct("id", "score"), F.struct(F.col("score"), -F.col("id"))).alias("x"))
    return best.select("raw_id", F.col("x.id").alias("id"), F.round("x.score", 6).alias("score"))


def resolve_terms(terms: DataFrame, index: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(term, kind, name, rank): names (kind, name, papers) that hold a term, the most frequent of each kind."""
    low = index.select("name", F.lower("name").alias("text")).distinct()
    asked = terms.select("term", F.lower("term").alias("_low")).distinct()
    found = index_of(low).find(asked.select(F.col("_low").alias("term"))).toDF("_low", "text")
    rows = asked.join(found, "_low").join(low, "text").select("term", "name").join(index, "name")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("term", "kind").orderBy(F.desc("papers"), "name")))
    keep = F.lit(False)
    for kind, k in limits.items():
        keep = keep | ((F.col("kind") == kind) & (F.col("rank") <= k))
    return rows.where(keep).select("term", "kind", "name", "rank")
