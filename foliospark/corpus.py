"""A synthetic revision corpus over the orders table, as one SQL expression that Spark and other engines evaluate alike.

A customer is a document, their orders are its blocks by key; a block's text
is one of fourteen frames.  It grows with the table and needs no files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORIGINAL = """case o_orderkey % 14
 when 0 then '# 研究背景与意义 ' || cast(o_orderkey % 9 + 1 as string)
 when 1 then '# 模型架构设计'
 when 2 then '# 实验结果分析'
 when 3 then '近年来，随着数据规模扩大，相关研究持续增加。本研究围绕文本质量展开分析。本研究提出了统一的处理流程，并构建了验证数据。'
 when 4 then '该系统采用 ResNet50 和 BERT_base 两种结构，在 ' || cast(o_orderkey as string) || ' 个样本上训练 12 轮，准确率达到 93.50%。结果表明该方法优于基线[3][4]。'
 when 5 then '因此，该模型能够保持稳定。由此，系统可以减少误报。同时，该策略提升了效率。'
 when 6 then '图 2-1 系统流程如图所示'
 when 7 then 'This paper describes a simple method for order ' || cast(o_orderkey as string) || ' and its evaluation.'
 when 8 then '| 名称 | 数值 |'
 when 9 then '[' || cast(o_orderkey as string) || '] Smith J. A study of methods. 2019.'
 when 10 then '在方法上，本研究旨在构建完整的评估流程，从而实现数据的统一管理。不仅提升了效率，还降低了成本。'
 when 11 then '模型权重保存在 checkpoints/run_' || cast(o_orderkey as string) || '.pth 中，可以直接加载使用。'
 when 12 then '- 第一项内容'
 else '本文讨论的核心问题是如何在有限样本下提升检测效果。本文提出的方法包括三个部分：采样、训练、评价。随后进行分析。许多学者认为这具有重要意义。' end"""

REVISED = """case
 when o_orderkey % 14 = 0 and o_orderkey % 5 = 0 then '# 研究背景'
 when o_orderkey % 14 = 3 then '近年来，随着数据规模扩大，相关研究持续增加。本研究围绕文本质量展开分析，提出了统一的处理流程。'
 when o_orderkey % 14 = 4 and o_orderkey % 3 = 0 then '该系统采用 ResNet50 结构，在多个样本上训练 12 轮，准确率达到 93.5%。结果表明该方法优于基线[3]。'
 when o_orderkey % 14 = 4 then '该系统采用 ResNet50 和 BERT_base 两种结构，在 ' || cast(o_orderkey as string) || ' 个样本上训练 12 轮，准确率达到 93.5%。结果显示该方法优于基线[3][4]。'
 when o_orderkey % 14 = 5 then '该模型能够保持稳定。系统可以减少误报。大多数用户认为效率提升了 20%。'
 when o_orderkey % 14 = 6 and o_orderkey % 4 = 0 then '图 2-1 系统流程如图所示：。'
 when o_orderkey % 14 = 10 then '本研究用于构建完整的评估流程，并实现数据的统一管理。我们选择既提升效率，也降低成本的方案。'
 when o_orderkey % 14 = 13 then '本文讨论的核心问题是如何在有限样本下提升检测效果。方法包括三个部分：采样、训练、评价；随后分析。'
 else {original} end""".format(original=ORIGINAL)

BLOCKS = f"""select o_custkey as doc_id, o_orderkey as block_key,
 cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as block_id, {ORIGINAL} as text, {REVISED} as revised,
 o_orderkey % 3 <> 0 as changed, cast(o_orderkey % 4 as int) as sentence_changes, cast(o_orderkey % 5 % 3 as int) as cluster_changes,
 cast(o_orderkey % 7 as int) as discourse_score, cast(o_orderkey % 11 as double) / 16 as coverage, o_orderkey % 17 = 0 as heavy, o_orderkey % 6 < 2 as sensitive
from orders"""

#: block kinds and lines that the frames lack
LINES = """(values
 (1, '# Title' || chr(10) || chr(10) || 'First line' || chr(10) || 'second line' || chr(10) || '- item' || chr(10) || '  more' || chr(10) || '> quote'),
 (2, '| a | b |' || chr(10) || '|---|---|' || chr(10) || 'text' || chr(10) || '## Next' || chr(10) || '## Again'),
 (3, '[ref]: http://x.example' || chr(10) || chr(10) || chr(10) || '1. one' || chr(10) || '2. two' || chr(10) || 'tail  '),
 (4, ''))"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(BLOCKS.replace("from orders", "from {orders}"), orders=orders)


def sample_lines(spark: SparkSession) -> DataFrame:
    return spark.sql(f"select col1 as doc_id, col2 as text from {LINES}")
