"""Rule tables. The values below are fixed: results depend on each of them and on their order."""

from __future__ import annotations

#: Role families and the substrings of title and text that name them; the first family wins.
ROLES = (
    ("Fraud Analytics", ("fraud", "fraude", "financial crime", "aml", "anti-money")),
    ("Risk Analytics", ("risk analyst", "risk analytics", "risk control", "risk manager", "operational risk", "market risk", "credit risk", "derivatives compliance", "ризик-аналітик", "риск-аналитик")),
    ("Quant / Research", ("quant", "quantitative", "research analyst", "researcher")),
    ("Trading Analytics", ("trading analyst", "trading operations", "execution analyst")),
    ("Market Data", ("market data", "pricing data", "reference data")),
    ("Product Analytics", ("product analyst", "product analytics", "growth analyst", "продуктовий аналітик", "продуктова аналітика", "продуктовая аналитика")),
    ("Business Analytics", ("business analyst", "business analytics", "strategy analyst", "бізнес-аналітик", "бизнес-аналитик")),
    ("BI / Reporting", ("bi analyst", "business intelligence", "power bi", "tableau")),
    ("Analytics Engineering", ("analytics engineer", "analytics engineering", "dbt")),
    ("Data Analytics", ("data analyst", "data analytics", "data analysis", "analyste de données", "analyste de donnees", "аналітик даних", "аналитик данных", "дата-аналітик", "дата-аналитик")),
    ("Software / Engineering", ("software engineer", "developer", "c++", "backend engineer")),
)

#: Skills and the patterns (on folded text) that name them.
SKILLS = (
    ("SQL", r"\bsql\b"),
    ("Python", r"\bpython\b"),
    ("Excel", r"\bexcel\b|microsoft excel"),
    ("Power BI", r"power\s*bi"),
    ("Tableau", r"\btableau\b"),
    ("Looker", r"\blooker\b"),
    ("dbt", r"\bdbt\b"),
    ("Snowflake", r"\bsnowflake\b"),
    ("BigQuery", r"\bbigquery\b"),
    ("Airflow", r"\bairflow\b"),
    ("VBA", r"\bvba\b"),
    ("DAX", r"\bdax\b"),
    ("R", r"(?:^|[^a-z])r(?:[^a-z]|$)|\br programming\b"),
    ("C++", r"c\+\+"),
    ("Spark", r"\bspark\b|pyspark"),
    ("Statistics", r"statistics|statistical|statistiques"),
    ("A/B testing", r"a/b testing|ab testing|experimentation"),
    ("AI/LLM Tools", r"\bllm\b|large language models?|generative ai|\bgenai\b|chatgpt|claude\b|\bai/ml models\b|prompt engineering"),
    ("ML Engineering", r"predictive models?|optimi[sz]e?\s+machine learning algorithms?|train(?:ing)?\s+(?:an?\s+)?(?:ml|machine learning)\s+model|scikit-learn|tensorflow|pytorch"),
    ("Machine Learning", r"machine learning|\bml\b"),
    ("Blockchain", r"blockchain|on-chain|onchain|web3"),
    ("Crypto", r"crypto|cryptocurrency|digital assets|defi"),
    ("Market Data", r"market data|financial data|pricing data"),
    ("Risk Management", r"risk management|risk analytics|market risk|credit risk"),
    ("Fraud Detection", r"fraud detection|fraud analytics|financial crime|aml"),
    ("Financial Modeling", r"financial modeling|financial modelling|financial analysis"),
)

#: From the first of these on, a text speaks of what is welcome, not required.
PREFERRED = r"preferred|nice to have|nice-to-have|bonus|plus|желательно|souhaité|перевагою|плюсом|бажано"

#: Levels by title, in order.
TITLE_LEVELS = (
    ("Junior", r"\b(?:intern(?:ship)?s?|stage|alternance|apprentice(?:ship)?s?|graduate|junior|jr|trainee|entry[- ]level)\b|джун(?:іор|иор)?|молодш(?:ий|а)\b|стажер|стажист|практикант"),
    ("Manager", r"\b(?:manager|director|head of)\b|керівник"),
    ("Lead", r"\b(?:lead|principal|staff)\b|тімлід|team\s*lead|провідний"),
    ("Senior", r"\b(?:senior|sr)\b|expert haut niveau|сеньйор|синьйор|старш(?:ий|а)"),
    ("Mid-level", r"\b(?:confirm[ée]e?|middle)\b|мідл|миддл"),
)
_OWN_LEVEL = r"(?:\b(?:hiring|seeking|looking\s+for)\s+(?:an?\s+)?|рівня\s+|уровня\s+)"
#: Levels by text.
TEXT_JUNIOR = r"\b(?:internships?|junior|entry[- ]level|alternance|apprentice(?:ship)?s?|(?:recent|new)\s+grad(?:uate)?s?)\b|\bstage\s+(?:de\b|d['’])|джун(?:іор|иор)?|молодш(?:ий|а)\s|стажер|стажист|практикант"
TEXT_SENIOR = _OWN_LEVEL + r"senior\b|expert haut niveau|сеньйор|синьйор|старш(?:ий|а)"
TEXT_MIDDLE = _OWN_LEVEL + r"middle\b|мідл|миддл"

#: The cascade of work formats, on folded text.
HYBRID = r"\bhybrid\b|\bhybride\b|télétravail partiel|partially remote|\d+\s*(?:to\s*\d+\s*)?days?\s*(?:a|per)?\s*(?:week|month)?\s*(?:in|at)\s*(?:the\s*)?office|\d+\s*(?:to\s*\d+\s*)?jours?\s*(?:par\s*semaine\s*)?au\s*bureau|\bгібрид\w*|\bгибрид\w*"
REMOTE_FIRST = r"remote[- ]first"
IN_PERSON = r"quarterly|in[- ]person|on[- ]?site|come together|offsite|surges?"
REMOTE = r"\bremote\b|full[- ]remote|work from home|à distance|télétravail|distributed|віддалено|дистанційн|удал[её]нн"
ONSITE = r"on[- ]site|onsite|office[- ]based|sur site|présentiel|en présentiel|в офісі|в офисе|офісний формат|офисный формат|\bофіс\w*|\bофис\w*"
AT_OFFICE = r"\bat (?:the|our) (?!home\b)[a-z\s]{2,25}office\b"

#: Places that a location label may name, in the order in which they are listed.
COUNTRIES = (
    "USA", "UK", "Canada", "India", "Singapore", "Luxembourg", "Cyprus", "Bhutan", "Hong Kong", "Taiwan", "Poland", "France", "Germany", "United States", "United Kingdom", "Europe", "Asia", "EMEA", "European Union",
    "Colombia", "Spain", "United Arab Emirates", "UAE", "Netherlands", "Italy", "Portugal", "Ireland", "Mexico", "Ukraine", "Czech Republic", "Romania", "Sweden", "Switzerland", "Belgium", "Austria", "Australia",
    "Japan", "Brazil", "Argentina", "Israel", "Turkey", "Greece", "Norway", "Denmark", "Finland", "Philippines", "Indonesia", "Pakistan", "South Africa", "Nigeria", "Chile", "Peru", "Egypt", "Saudi Arabia", "New Zealand",
    "Malaysia", "Thailand", "South Korea", "China", "Kenya", "Vietnam",
)
#: Cities that stand for a country when none is named.
CITIES = (("London", "United Kingdom"), ("Paris", "France"), ("New York", "United States"), ("Nanterre", "France"), ("Malakoff", "France"))

#: Rates to the dollar.
FX = {"USD": 1.0, "$": 1.0, "EUR": 1.08, "€": 1.08, "GBP": 1.27, "£": 1.27, "UAH": 0.024, "ГРН": 0.024, "₴": 0.024}

#: What makes a posting unfit.
TITLE_MARKERS = ("senior", "sr.", "lead", "head of", "director", "principal", "staff", "manager")
TEXT_MARKERS = (
    "phd", "ph.d", "advanced python", "expert-level python", "expert python", "strong python skills", "counterparty underwriting", "prime brokerage", "credit risk management experience",
    "business development experience", "compliance testing", "payments fraud prevention", "edd/aml", "acams", "acfcs",
)
MIN_YEARS = 3
MOST_YEARS = 30
FRENCH_PHRASES = ("français courant", "maîtrise du français", "bilingue français", "langue française", "french speaking required", "fluent in french", "french mother tongue", "native french", "h/f", "f/h", "x/f/m", "h/f/x")
FRENCH_WORDS = ("vous", "vos", "notre", "nos", "votre", "poste", "candidat", "compétences", "équipe", "société", "rejoindre", "recherchons", "expérience", "mission", "missions", "les", "des", "dans", "avec", "être")
GERMAN_PHRASES = (
    "verhandlungssicheres deutsch", "fließend deutsch", "deutschkenntnisse", "deutsch als muttersprache", "muttersprache deutsch", "german speaking required", "fluent in german", "german mother tongue", "native german",
    "m/w/d", "w/m/d", "d/m/w", "m/w/x",
)
GERMAN_WORDS = ("und", "wir", "unsere", "ihre", "mitarbeiter", "unternehmen", "erfahrung", "kenntnisse", "aufgaben", "bewerbung", "kollegen", "gemeinsam", "berufserfahrung", "abteilung")
WORD_THRESHOLD = 3
NO_OFFICE_COUNTRIES = ("ukraine", "india")
LOW_QUALITY = (
    "no experience needed", "no experience required", "no prior experience", "learn to trade", "trading from scratch", "learning from scratch", "mastered with a mentor", "become a trader", "free trading course",
    "financial freedom", "novice specialist", "curiosity is more important than", "convenient to combine with study",
)
CONTEXT_TERMS = ("crypto", "cryptocurrency", "blockchain", "web3", "trading", "exchange", "market data", "digital assets", "defi", "on-chain")
CONTEXT_EXEMPT = ("data", "web_analytics")

#: Search phrases by category, in order (the first that matches a title labels it).
QUERIES = {
    "data": ("Data Analyst", "Data Analytics", "Junior Data Analyst", "Product Analyst", "Product Analytics", "Business Analyst", "BI Analyst", "Business Intelligence Analyst", "Analytics Engineer", "Strategy Analyst", "Research Analyst"),
    "web_analytics": ("Web Analyst", "Web Analytics Analyst", "Digital Analytics Analyst", "Digital Analyst"),
    "crypto": ("Crypto Data Analyst", "Blockchain Analyst", "Blockchain Data Analyst", "Crypto Analyst", "Web3 Analyst", "On-chain Analyst", "Onchain Analyst", "DeFi Analyst", "Crypto Research Analyst"),
    "trading": ("Trading Analyst", "Trading Operations Analyst", "Trading Operations", "Trading Data Analyst", "Trading Performance Analyst", "Execution Analyst", "Trading Support Analyst", "Market Analyst"),
    "market_data": ("Market Data Analyst", "Market Data Specialist"),
    "risk": ("Risk Analyst", "Trading Risk Analyst", "Market Risk Analyst", "Crypto Risk Analyst"),
    "fraud": ("Fraud Analyst", "Fraud Data Analyst", "Financial Crime Analyst", "AML Analyst"),
    "quant": ("Quant Analyst", "Quantitative Analyst", "Junior Quant", "Quant Researcher", "Quantitative Research Analyst", "Research Analyst", "Quant Research Assistant"),
}

#: Names of companies and places that don't tell postings apart.
LEGAL_SUFFIXES = ("inc", "llc", "ltd", "limited", "gmbh", "sa", "sas", "sarl", "bv", "nv", "corp", "corporation", "co", "plc", "ag", "oy", "ab", "srl", "sro", "spa", "pte", "pty", "lp", "llp")
REGION_WORDS = ("remote", "worldwide", "anywhere", "global", "international", "europe", "european", "emea", "apac", "latam", "americas", "union", "more", "and", "the", "hybrid", "onsite", "site", "віддалено", "кордоном")
COMPANY_RATIO, TITLE_RATIO = 0.92, 0.93

#: What the reports know of skills.
KNOWN_SKILLS = ("SQL", "Excel", "Python", "Power BI", "Tableau", "Snowflake", "BigQuery", "Statistics", "A/B testing", "AI/LLM Tools")
PARTIAL_SKILLS: tuple[str, ...] = ()
NOT_LEARNABLE = ("Crypto", "Blockchain")
LOW_CONFIDENCE = ("R", "Machine Learning")
LEARN_SHARE, OPTIONAL_SHARE, LEAST_NEAR_FIT, LEAST_CERTS, CERT_SPAN = 0.10, 0.03, 2, 3, 60
CERT_WORD = r"(?:certif\w*|сертиф\w*)"

#: Reasons of rejection by substrings of the folded review.
REASONS = {
    "language_other_than_english": ("мандарин", "китайск", "французск", "немецк", "испанск", "japanese", "японск", "mandarin", "german", "french", "spanish", "арабск"),
    "coding_too_deep": ("python", "кодинг", "coding", "programming", "software engineer", "алгоритм", "machine learning", " ml ", "data engineer", "engineering", "c++", "java", "scala"),
    "domain_expertise_missing": ("compliance", "edd", "aml", "kyc", "quant", "трейдинг", "trading", "audit", "бухгалт", "sales", "underwriting", "brokerage", "cfa", "actuar"),
    "seniority_too_high": ("senior", "manager", "lead", "director", "principal", "менеджер", "директор", "management", "managerial"),
    "experience_years_short": ("лет опыта", "years of experience", "years in", "стаж", "не хватает опыта", "нет такого опыта", "3+ years", "5+ years"),
    "location_or_onsite": ("офис", "релокейт", "переезд", "on-site", "onsite", "relocation", "office", "hybrid", "гибрид"),
    "low_quality_listing": ("воронк", "скам", "фейков", "boilerplate", "шаблон", "не содержит", "не соответствует", "текст вакансии"),
}
STRUCTURAL = ("language_other_than_english", "location_or_onsite", "low_quality_listing")

#: Certificates and tools of the market report: name, pattern, case matters.
_TOOLS = r"power\s?bi|tableau|looker|snowflake|bigquery|big\s+query|dbt|google\s+analytics|ga4|sql|python|excel|metabase"
CERTIFICATES = (
    ("PL-300 / Power BI Data Analyst Associate / Microsoft Certified", r"\bpl-?300\b|power\s?bi\s+data\s+analyst\s+associate|microsoft\s+certified"),
    ("Tableau Desktop Specialist / Certified Data Analyst", r"tableau\s+desktop\s+specialist|tableau\s+certified(?:\s+data\s+analyst)?|tableau\s+(?:desktop\s+)?certification"),
    ("Google Data Analytics Certificate", r"google\s+data\s+analytics\s+(?:professional\s+)?certificat\w*"),
    ("Google Analytics / GA4 certification", r"(?:google\s+analytics|ga4)\s+(?:certification|certificate|qualification|iq)|\bgaiq\b"),
    ("IBM Data Analyst", r"\bibm\s+data\s+analyst"),
    ("CompTIA Data+", r"\bcomptia\s+data\+?|data\+\s+certif\w*"),
    ("GitHub Foundations", r"github\s+foundations"),
    ("dbt certification", r"\bdbt\s+(?:analytics\s+engineering\s+)?certif\w*"),
    ("certification near a tool name", rf"{CERT_WORD}[^\n]{{0,60}}?\b(?:{_TOOLS})\b|\b(?:{_TOOLS})\b[^\n]{{0,60}}?{CERT_WORD}"),
)
EXCEL_VERB = r"\bexcel\b\s+(?:in|at|as|with|when|under|on|by|while|through|and\s+(?:grow|thrive))"
TOOLS = (
    ("SQL", r"\b(?:sql|mysql|postgresql|postgres)\b"),
    ("Python", r"\bpython\b"),
    ("Excel", r"(?<![Tt]o )\bexcel\b(?!\s+(?:in|at|as|with|when|under|on|by|while|through|and\s+(?:grow|thrive)))"),
    ("Power BI", r"power\s?bi"),
    ("Tableau", r"\btableau\b"),
    ("Looker", r"\blooker\b|\blookml\b"),
    ("GA4 / Google Analytics", r"\bga4\b|google\s+analytics|universal\s+analytics"),
    ("dbt", r"\bdbt\b"),
    ("BigQuery", r"\bbig\s?query\b"),
    ("Snowflake", r"\bsnowflake\b"),
    ("Dune", r"(?i:dune\s+analytics|dune\.com)|\bDune\b"),
    ("Metabase", r"\bmetabase\b"),
)
CASE_SENSITIVE = ("Dune",)
REQUIRED_NEAR = r"\b(?:required|requirements?|must|mandatory|essential|needed?)\b|обязательн|обов'язков|необходим"
PREFERRED_NEAR = r"\b(?:preferred|prefer|nice\s+to\s+have|a\s+plus|bonus|desirable|desired|advantage|asset|ideally)\b|плюсом|бажан|перевага|вітається|желательн"
EUROPE = (
    "ukraine", "poland", "germany", "france", "spain", "italy", "portugal", "netherlands", "belgium", "ireland", "united kingdom", "uk", "switzerland", "austria", "sweden", "norway", "denmark", "finland", "czechia",
    "czech republic", "romania", "bulgaria", "cyprus", "greece", "hungary", "estonia", "latvia", "lithuania", "serbia", "croatia", "slovakia", "slovenia", "malta", "luxembourg", "europe",
)
LEVELS = (("Junior", "junior"), ("Mid-level", "middle"), ("Senior", "senior"), ("Lead", "senior"), ("Manager", "senior"))

#: Which copy of a job is shown, and what takes it off the list.
SOURCE_ORDER = ("Company Careers", "Djinni", "Himalayas", "Jobicy", "We Work Remotely", "RemoteOK", "LinkedIn")
YES, MAYBE, NO, MARK = "Подходит", "Возможно", "Не подходит", "Да"
HANDLED = ("sent", "rejected")

#: Banners (folded) by which a page says that its posting is gone, for any site and for two of their own.
CLOSED_BANNERS = (
    "job is no longer available", "this job has expired", "position has been filled", "page not found", "404 not found", "the job ad is no longer active", "ця вакансія зараз неактивна",
)
LINKEDIN_CLOSED = (
    "no longer accepting applications", "job is no longer available", "this job has expired", "job has been closed", "position has been closed", "doesn't exist", "unable to load the page", "may not be valid",
    "job posting has been removed",
)
WTTJ_CLOSED = ("job is no longer available", "this job has expired", "position has been filled", "offre n'est plus disponible", "offre a été pourvue")
#: Signs of a login wall, in the address and in the text.
LINKEDIN_WALL_URLS = ("/login", "/authwall", "/checkpoint", "/connect-services")
LINKEDIN_WALL_TEXTS = (
    "sign in to see more jobs", "log in to see more jobs", "join linkedin", "войти в linkedin", "identifiez-vous pour voir plus d'offres d'emploi", "connectez-vous pour voir plus d'offres d'emploi",
    "keep your linkedin services", "choose how we use your data for personalized ads",
)
WTTJ_WALL_URLS = ("/authenticate/", "/login", "/signup", "/signin")
#: Sources that state pay themselves, so that none is read out of their texts; sources whose titles are held against their category.
PAY_STATED = ("Jobicy", "Himalayas")
DESCRIPTION_CHARS = 6000
ANALYSIS_NOTE = "Rule-based first pass; review before using for decisions."
