"""Vocabularies that results depend on."""

# The symbols of the elements, in order of number.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U"
).split()

# Names of electrode configurations.
ELECTRODE_CONFIGS = [("half cell", "half-cell"), ("full cell", "full-cell"), ("coin cell", "coin-cell"), ("pouch cell", "pouch-cell"), ("symmetric cell", "symmetric-cell"), ("symmetrical cell", "symmetric-cell")]

# Lines with one of these are noise.
NOISE = [
    "graphical abstract", "entry for", "corresponding author", "author contributions", "received:", "revised:", "accepted:", "published:", "cite this",
    "read online", "access", "metrics & more", "article recommendations",
]
NOISE_IN_EXTRACTS = ["keywords:", "highlights", "abstract", "toc graphic"]
JOURNALS = [
    "vol.", "pp.", "doi", "lett.", "mater.", "chem.", "sci.", "energy", "nature", "adv.", "angew.", "j.", "trans.", "comm.",
    "science", "cell", "pnas", "acs", "rsc", "phys.", "rev.", "lett", "nanotech",
]
CHART_STARTS = ["line ", "bar ", "scatter ", "boxplot ", "textimage ", "naturalimage ", "chemical "]
KEEP_SECTIONS = [
    "experimental", "results", "discussion", "methods", "materials", "synthesis", "characterization", "electrochemical", "computation",
    "simulation", "supporting information", "supplementary",
]
SKIP_SECTIONS = ["abstract", "introduction", "intro", "background", "overview"]
END_SECTIONS = ["references", "bibliography", "acknowledgements", "acknowledgments", "author information", "author contributions", "corresponding author"]

# Battery kinds by keyword, in order; the first with a hit counts.
BATTERY_KINDS = [
    ("Li-ion/Li-metal", ["lithium ion", "li-ion", "li ion", "lithium metal", "li metal", "li-metal", "intercalation", "graphite anode", "lithiation", "lib", "lithium-ion battery", "lithium-metal battery"]),
    ("Li-S", ["lithium sulfur", "li-s", "li s", "lithium-sulfur", "sulfur cathode", "polysulfide", "li–s"]),
    ("Li-air", ["lithium air", "li-air", "li air", "lithium oxygen", "li-o2", "li o2", "lithium–air", "li–air", "li–o2"]),
    ("Solid-state", ["solid state", "solid-state", "solid electrolyte", "sulfide electrolyte", "oxide electrolyte", "polymer electrolyte", "all-solid-state", "ceramic electrolyte", "in situ polymerized"]),
]
REVIEW = [
    "review", "overview", "survey", "perspective", "state of the art", "reflection", "opinion", "comment", "viewpoint", "critical review", "comprehensive review",
    "mini review", "recent progress", "recent advance", "current status", "future direction",
]
RECYCLING = [
    "recycl", "recovery", "leaching", "regeneration", "spent battery", "spent cathode", "spent lithium", "circular economy", "urban mining", "second life",
    "second-life", "end-of-life", "battery waste", "decommission", "回收", "再生", "浸出", "退役",
]

# Labels of paragraphs, in the order that settles ties, with their keywords; a
# keyword that is listed twice counts twice.
PARAGRAPH_LABELS = [
    ("电化学性能", [
        "capacity", "retention", "cycle", "cycling", "rate capability", "voltage", "coulombic", "c-rate", "mah g", "a g", "ma g", "energy density", "power density",
        "polarization", "overpotential", "wh kg", "wh l", "areal capacity", "eis", "gitt", "容量", "循环", "倍率", "库仑", "能量密度", "过电位", "极化", "面容量"]),
    ("材料属性与表征", [
        "conductivity", "ionic conductivity", "electronic conductivity", "s cm", "diffusion coefficient", "transference number", "electrochemical window", "impedance",
        "modulus", "hardness", "young", "mechanical", "thermal", "tga", "dsc", "decomposition temperature", "porosity", "pore", "bet", "band gap", "bandgap",
        "电导率", "离子电导", "扩散系数", "迁移数", "电化学窗口", "模量", "孔隙率", "带隙", "能带", "xrd", "x-ray diffraction", "sem", "tem", "xps", "raman", "ftir",
        "ft-ir", "lattice parameter", "space group", "crystal structure", "particle size", "morphology", "eds", "icp", "晶格", "空间群", "晶体结构", "粒度", "形貌", "衍射",
        "surface film", "sei", "cei"]),
    ("材料制备", [
        "synthesized", "prepared", "fabricated", "calcined", "annealed", "coated", "doped", "mixed", "dissolved", "stirred", "heated", "dried", "assembled", "precipitation",
        "sol-gel", "hydrothermal", "ball mill", "sintering", "coprecipitation", "co-precipitation", "slurry", "tape casting", "hot press", "sps", "atomic layer", "ald", "cvd",
        "制备", "合成", "退火", "煅烧", "涂覆", "烧结", "共沉淀", "水热", "球磨", "组装", "干法", "包覆", "掺杂", "溶液配制"]),
    ("机理/模拟", [
        "dft", "first-principles", "first principles", "density functional", "molecular dynamics", "ab initio", "nudged elastic band", "band structure", "density of states",
        "bader charge", "migration barrier", "activation energy", "formation energy", "mechanism", "degradation", "failure", "nucleation", "dendrite", "crack", "space charge",
        "dead layer", "phase field", "finite element", "dft", "第一性原理", "分子动力学", "能带", "扩散能垒", "机理", "失效", "成核", "枝晶", "相场", "有限元", "monte carlo", "pinn"]),
    ("概述", [
        "introduction", "review", "overview", "background", "summary", "lithium-sulfur", "lithium-air", "li-s", "li-air", "solid state", "future perspective", "challenge",
        "prospect", "recent advance", "electric vehicle", "grid storage", "consumer electronics", "energy storage system", "portable", "mobile",
        "引言", "综述", "背景", "概述", "挑战", "展望", "进展", "锂硫", "固态", "锂空", "储能", "电动汽车", "conclusion", "concluding", "summary", "summary and outlook"]),
]
DEFAULT_LABEL = "概述"

# Parts of the names of supplementary files.
SUPPLEMENT_NAMES = ["_si_", "_si.", "-si_", "-si.", "supplement", "supporting", "_suppl", "_supp.", "appendix", "appendices", "_sm_", "_sm.", "_esi_", "_esi."]

# Kinds of question by keyword, in order.
QUESTION_KINDS = [
    ("screening", ["筛选", "候选", "哪种", "对比", "比较", "vs", "优缺点", "区别", "优劣"]),
    ("numeric", ["多少", "容量", "电压", "能量密度", "电导率", "电流", "效率", "温度", "循环"]),
    ("experiment", ["怎么做", "如何做", "制备", "合成", "测试", "表征"]),
    ("trend", ["发展方向", "趋势", "前景", "下一代", "前沿", "最新"]),
    ("definition", ["什么是", "定义", "概念", "是什么意思"]),
]
# Kinds of relation by keyword, in order.
RELATION_KINDS = [
    ("doping", ["dop", "doped", "substitut", "掺杂", "共掺", "co-dop"]),
    ("compatibility", ["incompatible", "compatible", "不适用", "适用于", "oxidation", "decompos", "dendrite", "窗口", "corrosion", "不可行"]),
    ("performance", ["mah/g", "mah g", "wh/kg", "wh kg", "retains", "retention", "capacity of", "conductivity", "s/cm", "coulombic efficiency"]),
]
# Additives as they are written.
ADDITIVES = [("lidfob", "LiDFOB"), ("lipo2f2", "LiPO2F2"), ("libob", "LiBOB"), ("lino3", "LiNO3"), ("fec", "FEC"), ("vc", "VC"), ("dtd", "DTD")]
# Words of a question that name the component it is about, in order; words that ask for a comparison; what every plan has.
PLAN_COMPONENTS = [
    ("cathode", ["正极", "NCM", "LFP", "高镍", "LRMO", "富锂"]),
    ("anode", ["负极", "金属锂", "石墨", "硅", "硬碳"]),
    ("electrolyte", ["电解液", "溶剂", "添加剂", "LiFSI", "LHCE"]),
]
PLAN_SCREENING = ["对比", "筛选", "vs", "哪种", "区别"]
PLAN_LABELS = ["电化学性能", "材料属性与表征"]
PLAN_OUTLINE = ["目标与路线", "推荐材料组合", "预期指标", "可行性依据", "风险评估"]

# Words of a chemistry that is not lithium's, in evidence; words of lithium in evidence and in schemes.
FOREIGN_CHEMISTRY = ["钠离子", "na-ion", "sodium-ion", "硬碳钠电", "mose2", "na3v2", "钾离子", "k-ion"]
LITHIUM_IN_EVIDENCE = ["li", "锂", "lithium"]
LITHIUM_IN_SCHEMES = ["li", "锂", "lithium", "ncm", "lfp", "lhce", "lp40"]
# Patterns of the ways of synthesis.
ROUTES = [
    ("solid_state", r"(?:高温)?固相(?:法|合成|烧结|路线|反应)"),
    ("sol_gel", r"(?:溶胶[-–—\s]*凝胶|sol[-–—\s]*gel|pechini)(?:法|路线)?"),
    ("carbonate_coprecipitation", r"(?:碳酸盐(?:共沉淀|路线|前驱体)?|\([^)]+\)CO3)"),
    ("hydroxide_coprecipitation", r"(?:(?:\(OH\)\s*2)|氢氧化物(?:共沉淀|路线|前驱体)?)"),
]
