"""Texts of findings and narratives. ``{name}`` stands for a value."""

from __future__ import annotations

PROFIT, MARKETING, INVENTORY, TREND = "Profit Leak", "Marketing Efficiency", "Inventory Risk", "Trend Diagnosis"
ENGLISH, CHINESE = "English", "中文"

#: Names of the tasks by language.
TASK_LABELS = {
    ENGLISH: {PROFIT: "Profit Leak", MARKETING: "Marketing Efficiency", INVENTORY: "Inventory Risk", TREND: "Trend Diagnosis"},
    CHINESE: {PROFIT: "利润泄漏", MARKETING: "营销效率", INVENTORY: "库存风险", TREND: "趋势诊断"},
}
#: Questions asked where the user asks none.
DEFAULT_QUESTIONS = {
    ENGLISH: {
        PROFIT: "Which category is leaking contribution profit, and what should I validate first?",
        MARKETING: "Which paid channel is least efficient, and what should I validate before reallocating budget?",
        INVENTORY: "Which SKU has the strongest sustained demand concentration, and what inventory data should I validate?",
        TREND: "What material trend or anomaly should I investigate first?",
    },
    CHINESE: {
        PROFIT: "哪个品类的贡献利润流失最严重？我应该优先验证哪些实际成本字段？",
        MARKETING: "哪个付费渠道的效率最低？在调整预算前应核验哪些数据？",
        INVENTORY: "哪个 SKU 的持续需求集中度最高？我应该核验哪些库存数据？",
        TREND: "当前最值得优先调查的趋势或异常是什么？",
    },
}
#: Sentences over the totals of a table and over a simulation, by language.
EVIDENCE = {
    ENGLISH: "Rows={rows}; Orders={orders}; Observed net revenue={revenue}; Simulated contribution profit={profit}; Simulated margin={margin}; Simulated allocated ad spend={ads}; Return-line rate={returns}.",
    CHINESE: "数据行数={rows}；订单数={orders}；观测净收入={revenue}；模拟贡献利润={profit}；模拟利润率={margin}；模拟广告分摊={ads}；退货交易行比例={returns}。",
}
SIMULATED = {
    ENGLISH: "{trials} seeded trials · P5 {p5} · median {p50} · P95 {p95} · probability of loss {loss}. This is a planning simulation, not a forecast guarantee.",
    CHINESE: "{trials} 次固定随机种子模拟 · P5 {p5} · 中位数 {p50} · P95 {p95} · 亏损概率 {loss}。这是规划模拟，不是预测保证。",
}
#: The rules by which decisions name their target, and what is said where nothing can be named.
RULES = {PROFIT: "largest positive margin-based estimated profit leakage", MARKETING: "lowest contribution profit per advertising pound among paid channels", INVENTORY: "highest non-return unit demand among SKUs with sustained transaction frequency"}
NO_TARGET = {
    PROFIT: "Profit Leak requires at least one category with positive revenue",
    MARKETING: "Marketing Efficiency requires at least one channel with positive ad spend",
    INVENTORY: "Inventory Risk requires a SKU with sustained non-return demand",
}
#: Headings that a narrative must have.
HEADINGS = {ENGLISH: ("### Interpretation", "### Recommended validation", "### Limitations"), CHINESE: ("### 解读", "### 建议验证", "### 局限性")}
OPEN_HEADINGS = {ENGLISH: ("### Finding", "### Evidence", "### Recommended validation", "### Limitations"), CHINESE: ("### 发现", "### 证据", "### 建议验证", "### 局限性")}
#: What a narrator is told where a decision is final, and where there is none.
PROMPT = {
    ENGLISH: "You put a finished analysis into words. Its figures and the entity it names are final: compute nothing, rank nothing, replace nothing.\n\nTask: {task}\nQuestion: {question}\nDecision: {decision}\nTotals: {evidence}\n\nRules:\n1. Write about {target} and about no other entity.\n2. Give no amount, share, count or other figure; readers see them beside your text.\n3. {rule}\n4. What goes together is not thereby a cause. Let people act: propose checks, no automatic financial step.\n5. Plain Markdown only, without HTML, XML, SVG, code, tables or tool calls.\n\nWrite under exactly these headings:\n{headings}",
    CHINESE: "你负责用文字说明一项已经完成的分析。数字与所选对象均为最终结果：不要计算、排名或更换。\n\n任务：{task}\n问题：{question}\n决策：{decision}\n汇总：{evidence}\n\n规则：\n1. 只写 {target}，不写其他对象。\n2. 不要写出金额、比例、数量或任何其他数字，读者会在旁边看到。\n3. {rule}\n4. 同时出现并不等于因果；只建议由人核查，不提出自动的财务操作。\n5. 只用普通 Markdown，不含 HTML、XML、SVG、代码、表格或工具调用。\n\n必须使用以下标题：\n{headings}",
}
OPEN_PROMPT = {
    ENGLISH: "You read an analysis for a small trading team and say what it shows.\n\nTask: {task}\nQuestion: {question}\nTotals: {evidence}\nFirst rows of the table:\n{table}\n\nRules:\n1. Keep observed transactions apart from simulated cost and advertising.\n2. Invent no data, and call nothing a cause that only goes together.\n3. People approve every change of budget, purchasing or price.\n4. Plain Markdown only, without HTML, XML, SVG or tool calls; code only if the question asks for it.\n\nWrite under exactly these headings:\n{headings}",
    CHINESE: "你为一个小型贸易团队阅读分析结果，并说明其含义。\n\n任务：{task}\n问题：{question}\n汇总：{evidence}\n表格前几行：\n{table}\n\n规则：\n1. 区分观测到的交易与模拟的成本和广告。\n2. 不编造数据，不把相关说成因果。\n3. 预算、采购或价格的任何变化都须由人批准。\n4. 只用普通 Markdown，不含 HTML、XML、SVG 或工具调用；只有问题要求时才写代码。\n\n必须使用以下标题：\n{headings}",
}
#: What a narrator must say and may not say of a task.
TASK_RULES = {
    (ENGLISH, PROFIT): "Say that costs, advertising, fees and fulfilment are simulated. Propose to check real landed cost, the allocation of advertising, platform fees, fulfilment cost and returns.",
    (CHINESE, PROFIT): "说明成本、广告、费用与履约均为模拟值；建议核查真实到岸成本、广告分摊、平台费、履约成本和退货。",
    (ENGLISH, MARKETING): "Say that channels, advertising and contribution costs are simulated. Before budget moves, propose to check attributed revenue, real spend, channel fees, conversion tracking and the quality of cohorts.",
    (CHINESE, MARKETING): "说明渠道、广告与贡献成本均为模拟值；在移动预算之前，建议核查归因收入、真实支出、渠道费用、转化追踪和客群质量。",
    (ENGLISH, INVENTORY): "Speak of lasting concentration of demand only; stock on hand, stockouts, buffers and shares of returns are unknown. Propose to check stock on hand, open orders, lead time, reorder point, season and recent demand.",
    (CHINESE, INVENTORY): "只谈持续的需求集中；现有库存、缺货、缓冲和退货比例均未知。建议核查现有库存、在途订单、交货期、补货点、季节和近期需求。",
}
#: Findings by language and task.
FINDINGS = {
    (ENGLISH, PROFIT): "### Verified finding\n**{target}** has the largest estimated margin-based profit leakage. Its simulated contribution margin is **{margin}**, versus the portfolio margin of **{portfolio}**. The margin gap is **{gap} percentage points**, corresponding to approximately **{leakage}** of contribution profit below the portfolio-margin benchmark.\n\n*Revenue is observed from the transaction sample; cost, advertising, fee and fulfilment inputs are simulated.*",
    (CHINESE, PROFIT): "### 已验证结论\n**{target}** 的估算利润率缺口最大。其模拟贡献利润率为 **{margin}**，组合整体利润率为 **{portfolio}**，相差 **{gap} 个百分点**，对应约 **{leakage}** 的基准贡献利润缺口。\n\n*收入来自观测交易样本；成本、广告、平台费和履约字段为模拟数据。*",
    (ENGLISH, MARKETING): "### Verified finding\nAmong channels with positive advertising spend, **{target}** has the lowest simulated contribution profit per advertising pound: **£{pound} per £1 of ad spend**. Its observed revenue-to-ad-spend ratio is **{roas}x**, and its simulated contribution profit per order is **£{order}**.\n\n*Revenue is observed; channel labels, advertising allocation and contribution-cost inputs are simulated.*",
    (CHINESE, MARKETING): "### 已验证结论\n在广告支出大于零的渠道中，**{target}** 的模拟广告效率最低：每投入 £1 广告费产生 **£{pound}** 的贡献利润。其观测收入广告比为 **{roas}x**，模拟每订单贡献利润为 **£{order}**。\n\n*收入来自观测数据；渠道标签、广告分摊和贡献成本字段为模拟数据。*",
    (ENGLISH, INVENTORY): "### Verified finding\n**SKU {target} — {description}** has the strongest sustained non-return demand among SKUs with at least **{lines} transaction lines**. It records **{units} units** across **{orders} orders**.\n\n*This is a demand-concentration signal, not confirmation of low stock or an imminent stockout; on-hand inventory and replenishment lead time are unavailable.*",
    (CHINESE, INVENTORY): "### 已验证结论\n**SKU {target} — {description}** 在至少有 **{lines} 条交易记录**的 SKU 中，持续非退货需求最强。该商品共售出 **{units} 件**，涉及 **{orders} 个订单**。\n\n*这是需求集中信号，并不代表库存已经不足或即将缺货；当前缺少在手库存与补货周期数据。*",
}
#: Narratives that stand in for one that was turned down.
SAFE = {
    (ENGLISH, PROFIT): "### Interpretation\n{target} falls furthest below the portfolio contribution-margin benchmark under the simulated cost model. This makes it the first category to investigate, not proof that the category itself causes the leakage.\n\n### Recommended validation\nReplace the simulated assumptions for {target} with actual landed-cost invoices, advertising allocation, platform fees and fulfilment charges. Then review returns and SKU-level results before changing price, budget or purchasing decisions.\n\n### Limitations\nThe transaction revenue is observed, but the cost and operational fields used in the margin calculation are simulated. The result is a validation priority and requires human review before action.",
    (CHINESE, PROFIT): "### 解读\n在模拟成本模型下，{target} 的贡献利润率与组合基准的差距最大，因此应优先核查；这并不证明该品类本身就是利润流失的原因。\n\n### 建议验证\n使用 {target} 的实际到岸成本发票、广告分摊、平台费用和履约费用替换模拟假设。在调整价格、预算或采购决策前，再检查退货和 SKU 级结果。\n\n### 局限性\n交易收入来自观测数据，但利润率计算使用的成本和运营字段为模拟值。该结果仅用于确定核查优先级，采取行动前必须人工复核。",
    (ENGLISH, MARKETING): "### Interpretation\n{target} is the first paid channel to investigate under the verified efficiency rule. This is an attribution-based diagnostic signal, not proof that the channel causes poor customer economics.\n\n### Recommended validation\nReconcile actual platform spend with attributed orders and revenue for {target}. Check tracking quality, channel fees, conversion windows and customer-cohort value before changing budget allocation.\n\n### Limitations\nChannel labels, advertising allocation and contribution-cost fields are simulated. The result prioritizes validation and does not authorize an automatic budget change.",
    (CHINESE, MARKETING): "### 解读\n按照已验证的效率规则，{target} 是最应优先核查的付费渠道。这是基于归因数据的诊断信号，并不能证明该渠道导致了较差的客户经济性。\n\n### 建议验证\n将 {target} 的实际平台支出与归因订单和收入进行核对。在调整预算前，检查追踪质量、渠道费用、转化窗口和客户群长期价值。\n\n### 局限性\n渠道标签、广告分摊和贡献成本字段为模拟值。该结果用于确定核查顺序，不会自动授权预算调整。",
    (ENGLISH, INVENTORY): "### Interpretation\nSKU {target} shows the strongest sustained demand concentration after excluding sparse, one-off transaction patterns. It is a replenishment-review priority, not confirmation that inventory is currently low.\n\n### Recommended validation\nCheck on-hand inventory, open purchase orders, supplier lead time, reorder point, seasonality and recent demand for SKU {target} before changing replenishment quantities.\n\n### Limitations\nThe dataset contains transaction demand but not authoritative on-hand stock, lead time or safety-stock targets. A human inventory review is required before action.",
    (CHINESE, INVENTORY): "### 解读\n排除稀疏的一次性交易模式后，SKU {target} 显示出最强的持续需求集中度。它应被优先纳入补货核查，但这并不代表当前库存不足。\n\n### 建议验证\n在调整补货数量前，检查 SKU {target} 的现有库存、在途采购订单、供应商交付周期、再订货点、季节性和近期需求。\n\n### 局限性\n数据集包含交易需求，但不包含权威的现有库存、交付周期或安全库存目标。采取行动前必须由人员完成库存复核。",
}
#: Wordings that contradict the evidence, by task.
CONTRADICTIONS = {
    PROFIT: (r"contribution profit.{0,35}(?:higher|greater|exceed).{0,20}revenue", r"revenue.{0,35}(?:lower|less).{0,20}contribution profit"),
    MARKETING: (r"most efficient", r"highly cost-effective", r"best-performing"),
    INVENTORY: (r"has sufficient stock", r"will stock out", r"is out of stock", r"inventory is low", r"return-line rate", r"return rate"),
}
#: Fixed value: what stands for a response without use.
UNUSABLE = "The model did not produce a usable narrative. Please retry with a more specific business question."


def canonical_task(label: str) -> str:
    """The task that a label of any language names; the first task if none does."""
    return next((task for labels in TASK_LABELS.values() for task, name in labels.items() if label in (task, name)), PROFIT)


def default_question(language: str, label: str) -> str:
    return DEFAULT_QUESTIONS[language][canonical_task(label)]
