"""Rule-based classification of questions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, compact

# Topics in the order in which they are tried, each with its words.
TOPIC_RULES = {
    "human-genome-project": (
        "人类基因组计划", "HGP", "遗传图", "物理图", "STS", "辐射杂交", "图谱",
    ),
    "sequencing-methods": (
        "测序", "Sanger", "链终止", "化学降解", "ART", "Illumina", "SAM", "读段", "平台",
    ),
    "genome-assembly": (
        "组装", "de Bru", "deBru", "DBG", "OLC", "contig", "scaffold", "重叠图", "mate-pair", "paired-end", "k-mer", "欧拉路径", "Hamilton",
    ),
    "alignment-homology": (
        "Blast", "BLAST", "Clustal", "BLOSUM", "PAM", "同源", "比对", "蛋白质序列",
    ),
    "annotation-prediction": (
        "注释", "GeneMark", "GENSCAN", "Augustus", "RepeatMasker", "Gnomon", "ProSplign", "RNA-Seq", "基因结构", "新基因",
    ),
    "hmm-regulation": (
        "HMM", "隐马尔可夫", "CpG", "TATA", "Forward", "Viterbi", "Baum-Welch", "启动子", "转录因子",
    ),
    "genome-databases": (
        "Ensembl", "UCSC", "Genbank", "RefSeq", "PubMed", "JGI GOLD", "数据库",
    ),
}
COMPUTED = "计算|概率|矩阵|图|路径|score|得分|联合输出概率"
TAG_RULES = {
    "hmm": "hmm|隐马尔可夫|cpg|tata",
    "alignment": "blast|clustal|blosum|pam|同源|比对",
    "assembly": "组装|de bru|olc|contig|scaffold|k-mer",
    "annotation": "注释|genemark|augustus|gnomon|repeatmasker",
    "sequencing": "测序|sanger|illumina|art|sam",
}


def topic_of(text: Column | str, rules: dict[str, tuple[str, ...]] = TOPIC_RULES, default: str = "general") -> Column:
    """The first topic of which any word occurs, letter case aside."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    out = None
    for topic, words in rules.items():
        hit = low.rlike("|".join(w.lower() for w in words))
        out = F.when(hit, topic) if out is None else out.when(hit, topic)
    return F.lit(default) if out is None else out.otherwise(default)


def type_of(answer: Column | str, prompt: Column | str, options: Column | str) -> Column:
    """Choice types if the answer is letters of options, else by whether there are options."""
    letters = compact(answer)
    given = F.coalesce(col(options), F.array().cast("array<struct<key:string,text:string>>"))
    keys = F.filter(F.transform(given, lambda o: o["key"]), lambda k: F.coalesce(k, F.lit("")) != "")
    choice = letters.rlike("^[A-Z]+$") & (F.size(F.array_except(F.split(letters, ""), F.concat(keys, F.array(F.lit(""))))) == 0)
    several = F.coalesce(col(prompt), F.lit("")).contains("[多选]") | (F.length(letters) > 1)
    return F.when(choice & several, "multiple_choice").when(choice, "single_choice").when(F.size(given) > 0, "short_answer").otherwise("open_ended")


def difficulty_of(prompt: Column | str, kind: Column, image: Column, options: Column) -> Column:
    points = [kind == "multiple_choice", kind.isin("short_answer", "open_ended"), image, F.lower(F.coalesce(col(prompt), F.lit(""))).rlike(COMPUTED), options <= 2]
    total = F.lit(2)
    for p in points:
        total = total + F.coalesce(p, F.lit(False)).cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(5), total))


def tags_of(prompt: Column | str, analysis: Column | str, topic: Column, kind: Column, image: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(col(prompt), F.lit("")), F.coalesce(col(analysis), F.lit(""))))
    tags = [topic, kind, F.when(image, "image-based"), F.when(F.coalesce(col(prompt), F.lit("")).contains("[多选]"), "multi-select")]
    tags += [F.when(text.rlike(rule), tag) for tag, rule in TAG_RULES.items()]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*tags))))


__all__ = ["difficulty_of", "tags_of", "topic_of", "type_of"]
