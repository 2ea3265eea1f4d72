"""The classes of documents, topics and functions, and the vocabulary of confidentiality."""

from __future__ import annotations

from typing import NamedTuple


class DocClass(NamedTuple):
    """A pattern that starts with ``=`` heeds case."""

    dimension: str
    id: str
    label: str
    patterns: tuple[str, ...]
    strong: tuple[str, ...]
    terms: tuple[str, ...]
    against: tuple[str, ...] = ()


# Patterns, strong terms, terms and terms against each class.
CLASSES = [
    DocClass("documentType", "nda", "Non-disclosure agreement", (r"\bnon[-\s]?disclosure agreement\b", r"\bmutual non[-\s]?disclosure\b", r"\bconfidentiality agreement\b", r"=\bNDA\b"), ("receiving party", "disclosing party", "shall not disclose"), ("confidential information", "trade secret", "permitted purpose")),
    DocClass("documentType", "msa", "Master services agreement", (r"\bmaster services? agreement\b", r"=\bMSA\b"), ("services agreement", "order form", "service levels"), ("the parties", "governing law", "term and termination")),
    DocClass("documentType", "sow", "Statement of work", (r"\bstatement of work\b", r"=\bSOW\b"), ("deliverables", "acceptance criteria", "scope of work"), ("milestones", "assumptions", "out of scope", "project plan")),
    DocClass("documentType", "contract", "Contract or agreement", (r"\bthis agreement is (?:made|entered)\b", r"\bin witness whereof\b", r"\bhereinafter referred to as\b"), ("governing law", "indemnif", "the parties agree", "termination for convenience"), ("clause", "whereas", "liability", "warranty", "counterparts", "force majeure"), ("non-disclosure agreement", "statement of work")),
    DocClass("documentType", "invoice", "Invoice", (r"\binvoice\s*(?:no|number|nr|#)\b", r"\btax invoice\b", r"\bamount due\b"), ("due date", "subtotal", "total due", "remit to", "vat number"), ("quantity", "unit price", "payment terms", "bank details")),
    DocClass("documentType", "purchase_order", "Purchase order", (r"\bpurchase order\b", r"\bPO\s*(?:no|number|#)\b"), ("ship to", "bill to", "order date"), ("unit price", "quantity", "delivery date", "requisition"), ("invoice no",)),
    DocClass("documentType", "quote", "Quote or proposal", (r"\bquotation\b", r"\bpricing proposal\b", r"\bvalid until\b"), ("pricing summary", "scope of supply", "commercial proposal"), ("list price", "discount", "total investment", "optional items")),
    DocClass("documentType", "meeting_notes", "Meeting notes", (r"\bminutes of (?:the )?meeting\b", r"\bmeeting notes\b"), ("attendees", "action items", "apologies", "next meeting"), ("agenda", "discussion", "decisions", "owner", "due")),
    DocClass("documentType", "policy", "Policy document", (r"\bthis policy (?:applies|sets out)\b", r"\bpolicy statement\b"), ("responsibilities", "scope of this policy", "policy owner"), ("compliance", "review date", "version control", "must", "employees")),
    DocClass("documentType", "specification", "Design or specification", (r"\bhigh[-\s]level design\b", r"\blow[-\s]level design\b", r"\bdesign document\b", r"\bfunctional specification\b"), ("requirements", "architecture", "data flow", "interfaces"), ("assumptions", "constraints", "components", "schema", "api")),
    DocClass("documentType", "roadmap", "Roadmap or plan", (r"\bproduct roadmap\b", r"\bdelivery plan\b", r"\broadmap\b"), ("milestone", "backlog", "release schedule", "target date"), ("quarter", "phase", "epic", "planned", "delivered", "short-term")),
    DocClass("documentType", "report", "Report", (r"\bexecutive summary\b", r"\bincident report\b", r"\bstatus report\b"), ("findings", "recommendations", "conclusion", "methodology"), ("background", "analysis", "appendix", "summary")),
    DocClass("documentType", "support_case", "Support case", (r"\bcase\s*(?:no|number|#)\b", r"\bticket\s*(?:no|number|#)\b"), ("root cause", "workaround", "resolution", "severity"), ("reported by", "steps to reproduce", "log", "escalated")),
    DocClass("documentType", "correspondence", "Email or letter", (r"(?m)^\s*(?:from|to|subject|cc)\s*:", r"\bdear (?:sir|madam|mr|mrs|ms)\b"), ("kind regards", "best regards", "yours sincerely", "yours faithfully"), ("hi team", "thanks", "please find attached", "following up")),
    DocClass("documentType", "cv", "CV or résumé", (r"\bcurriculum vitae\b", r"\bwork experience\b"), ("education", "employment history", "references available"), ("skills", "qualifications", "achievements", "languages")),
    DocClass("documentType", "payslip", "Payslip or payroll", (r"\bpay\s?slip\b", r"\bpayroll (?:report|register)\b"), ("gross pay", "net pay", "deductions"), ("tax code", "paye", "uif", "pension", "earnings")),
    DocClass("topic", "ip", "Intellectual property", (r"\bintellectual property\b", r"\btrade secrets?\b"), ("patent", "trademark", "copyright", "proprietary technology", "know-how"), ("invention", "licence", "license", "source code", "proprietary", "royalty")),
    DocClass("topic", "legal", "Legal", (r"\bgoverning law\b", r"\bindemnif"), ("liability", "jurisdiction", "breach of contract", "dispute resolution"), ("clause", "agreement", "contract", "warranty", "compliance", "regulation", "gdpr", "popia")),
    DocClass("topic", "sales", "Sales", (r"\bsales pipeline\b", r"\bwin rate\b"), ("opportunity", "quota", "renewal", "close date", "prospect"), ("deal", "discount", "forecast", "proposal", "account", "upsell", "churn")),
    DocClass("topic", "finance", "Finance", (r"\bcash flow\b", r"\bp&l\b", r"\bebitda\b"), ("revenue", "margin", "budget", "accrual", "reconciliation", "invoice", "payment terms", "total due", "subtotal"), ("cost", "expense", "tax", "vat", "payment", "variance", "amount")),
    DocClass("topic", "hr", "People and HR", (r"\bperformance review\b", r"\bdisciplinary\b"), ("recruitment", "onboarding", "grievance", "headcount", "remuneration", "gross pay", "net pay", "payroll", "deductions"), ("employee", "leave", "salary", "benefits", "probation", "appraisal", "paye", "tax code", "pension")),
    DocClass("topic", "it_security", "IT and security", (r"\baccess control\b", r"\bvulnerability\b"), ("firewall", "malware", "encryption", "authentication", "incident response"), ("server", "network", "backup", "patch", "outage", "database", "restore", "repository")),
    DocClass("topic", "procurement", "Procurement", (r"\brequest for proposal\b", r"\btender\b"), ("supplier", "sourcing", "contract award", "lead time"), ("vendor", "purchase order", "rfp", "rfq", "quotation", "buyer")),
    DocClass("topic", "marketing", "Marketing", (r"\bgo[-\s]to[-\s]market\b", r"\blead generation\b"), ("campaign", "brand", "positioning", "messaging"), ("collateral", "webinar", "seo", "launch", "audience", "creative")),
    DocClass("topic", "product", "Product", (r"\buser story\b", r"\bfeature request\b"), ("roadmap", "backlog", "release", "specification"), ("feature", "requirement", "beta", "enhancement", "defect", "sprint")),
    DocClass("topic", "operations", "Operations", (r"\bservice level agreement\b", r"\brunbook\b"), ("escalation", "workflow", "capacity", "throughput"), ("process", "sla", "ticket", "queue", "shift", "handover")),
    DocClass("function", "legal_dept", "Legal", (r"\blegal (?:team|department)\b", r"\bgeneral counsel\b", r"\blegal@"), ("contracts team", "company secretary", "in-house counsel"), ("paralegal", "compliance officer")),
    DocClass("function", "sales_dept", "Sales", (r"\bsales (?:team|department)\b", r"\bsales@"), ("account manager", "account executive", "sales director", "pre-sales"), ("territory", "sales engineer", "channel partner")),
    DocClass("function", "finance_dept", "Finance", (r"\bfinance (?:team|department)\b", r"\baccounts (?:payable|receivable)\b", r"\bfinance@"), ("financial controller", "cfo", "bookkeeper"), ("credit control", "treasury")),
    DocClass("function", "hr_dept", "HR", (r"\bhuman resources\b", r"\bhr (?:team|department)\b", r"\bhr@"), ("people team", "talent acquisition", "chro"), ("hr business partner", "payroll team")),
    DocClass("function", "it_dept", "IT", (r"\bit (?:team|department)\b", r"\bservice desk\b", r"\bhelpdesk\b", r"\bit@"), ("infrastructure team", "sysadmin", "ciso", "security operations"), ("network team", "platform team", "noc", "soc")),
    DocClass("function", "procurement_dept", "Procurement", (r"\bprocurement (?:team|department)\b", r"\bpurchasing department\b", r"\bprocurement@"), ("sourcing team", "category manager"), ("buyer", "supplier manager")),
    DocClass("function", "marketing_dept", "Marketing", (r"\bmarketing (?:team|department)\b", r"\bmarketing@"), ("brand team", "demand generation"), ("content team", "events team")),
    DocClass("function", "engineering_dept", "Engineering", (r"\b(?:engineering|development|product) team\b", r"\bdev team\b"), ("qa team", "platform engineering", "scrum team"), ("tech lead", "architect", "release manager")),
    DocClass("function", "support_dept", "Support", (r"\b(?:customer|technical) support\b", r"\bsupport (?:team|desk)\b", r"\bsupport@"), ("service delivery", "support engineer"), ("first line", "second line", "escalation engineer")),
    DocClass("function", "executive", "Executive", (r"\bboard of directors\b", r"\bexecutive (?:team|committee)\b", r"\bexco\b"), ("leadership team", "steering committee", "board pack"), ("ceo", "coo", "managing director")),
]
# File names that hint at a document type.
FILE_HINTS = {
    "nda": r"(?<![a-z])nda(?![a-z])|non[-_ ]?disclosure", "msa": r"(?<![a-z])msa(?![a-z])|master[-_ ]?services?", "sow": r"(?<![a-z])sow(?![a-z])|statement[-_ ]?of[-_ ]?work",
    "contract": "contract|agreement", "invoice": r"invoice|\binv[-_ ]?\d", "purchase_order": r"\bpo[-_ ]?\d|purchase[-_ ]?order", "quote": "quote|quotation|proposal", "meeting_notes": "minutes|meeting[-_ ]?notes",
    "policy": "policy", "specification": r"\bhld\b|\blld\b|design|spec\b", "roadmap": "roadmap|tracker|backlog", "report": "report", "support_case": r"case[-_ ]?\d|ticket[-_ ]?\d", "cv": "(?<![a-z])cv(?![a-z])|resume|curriculum", "payslip": "payslip|payroll",
}
# What a type says about the topic, and a topic about the function.
TYPE_TOPIC = {
    "nda": "legal", "msa": "legal", "sow": "legal", "contract": "legal", "invoice": "finance", "purchase_order": "procurement", "quote": "sales", "payslip": "hr",
    "cv": "hr", "specification": "it_security", "support_case": "it_security", "report": "operations", "meeting_notes": "operations", "roadmap": "product",
}
TOPIC_FUNCTION = {
    "ip": "legal_dept", "legal": "legal_dept", "sales": "sales_dept", "finance": "finance_dept", "hr": "hr_dept", "it_security": "it_dept",
    "procurement": "procurement_dept", "marketing": "marketing_dept", "product": "engineering_dept", "operations": "support_dept",
}
SENSITIVE_TYPES = ("nda", "msa", "sow", "contract", "quote", "roadmap", "specification", "payslip", "cv")
SENSITIVE_TOPICS = ("ip", "legal", "finance", "hr", "sales")
# Subjects that companies keep to themselves.
SUBJECTS = [
    ("roadmap", "unreleased product plans", ("roadmap", "milestone", "general availability", "ga date", "release schedule", "release plan", "backlog", "epic", "sprint", "launch date", "unreleased", "not yet released", "private beta", "closed beta", "early access", "eap", "tech preview", "upcoming release", "next version", "next release", "target release", "ship date", "feature flag", "deprecation plan", "sunset", "end of life", "phase 2", "phase two")),
    ("architecture", "internal architecture", ("high-level design", "low-level design", "design document", "architecture diagram", "data flow", "internal api", "service mesh", "topology", "failover design", "replication design", "sequence diagram", "component diagram", "infrastructure diagram", "database schema", "tech stack", "system design", "reference architecture", "proprietary algorithm")),
    ("pricing", "pricing detail", ("price list", "list price", "rate card", "cost price", "gross margin", "net margin", "discount", "uplift", "quota", "commission", "floor price", "deal desk", "pricing model", "tiered pricing", "transfer price", "margin")),
    ("strategy", "business strategy", ("go-to-market", "gtm", "competitive analysis", "competitor analysis", "battlecard", "win rate", "market share", "positioning", "differentiation", "swot", "business case", "board pack", "board paper", "five-year plan", "three-year plan", "strategic plan", "acquisition target", "restructure")),
    ("financial", "internal financials", ("forecast", "sales pipeline", "arr", "mrr", "churn", "bookings", "revenue target", "ebitda", "p&l", "budget variance", "headcount plan", "run rate", "burn rate", "attach rate")),
    ("security", "security architecture", ("threat model", "attack surface", "penetration test", "pen test", "vulnerability report", "security architecture", "incident response plan", "key rotation", "firewall rule", "firewall rules", "access matrix", "privileged access")),
    ("process", "internal process", ("internal process", "runbook", "playbook", "standard operating procedure", "escalation matrix", "on-call rota", "on-call rotation", "internal only", "internal use")),
]
# Patterns of confidentiality, publicity and structure.
CONFIDENTIAL_MARK = r"\b(?:strictly\s+)?confidential(?!ity\s+(?:policy|agreement|statement|clause|notice|undertaking))\b|\binternal use only\b|\bnot for (?:external )?distribution\b|\bdo not (?:share|distribute|forward)\b|\bcompany confidential\b|\bproprietary and confidential\b|\brestricted\b"
PUBLIC_MARK = r"\bpress release\b|\bfor immediate release\b|\bpublicly available\b|\bpublished\b|\bdatasheet\b|\ball rights reserved\b|\bterms of service\b|\bprivacy policy\b|\bconfidentiality policy\b|\buser guide\b|\bknowledge base\b|\bhelp cent(?:re|er)\b|\bavailable to all customers\b|\bgenerally available\b"
CONFIDENTIAL_WORDS = ("confidential", "internal", "not for", "do not", "restricted")
PUBLIC_WORDS = ("release", "public", "published", "datasheet", "rights", "terms", "privacy", "confidentiality", "guide", "knowledge", "help", "available")
FILE_MARK = r"\b(?:internal|confidential|restricted|private|nda|do[-_ ]?not[-_ ]?(?:distribute|share|forward))\b"
FILE_SUBJECT = r"roadmap|strategy|strategic|pricing|price[-_ ]?list|rate[-_ ]?card|internal|confidential|restricted|forecast|board|pipeline|budget|margin|competitive|battlecard|nda|q[1-4][-_ ]?(?:fy)?\d{2,4}|fy\d{2,4}|do[-_ ]?not[-_ ]?distribute"
SECTION_SUBJECT = r"roadmap|strategy|strategic|pricing|price[-_ ]?list|rate[-_ ]?card|forecast|board pack|pipeline|budget|margin|competitive|battlecard|q[1-4][-_ ]?(?:fy)?\d{2,4}|fy\d{2,4}"
ROADMAP_ROW = r"\b(?:Q[1-4]|H[12])\s*(?:FY)?\s*'?\d{2,4}\b|\b(?:20\d{2})\s*(?:target|plan|release|ga)\b"
TITLE_LINE = r"^(?:[A-Z][\w'&/-]*)(?:\s+(?:[A-Z][\w'&/-]*|of|and|for|the|to|in))*$"
