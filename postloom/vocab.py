"""Word lists, patterns and closed enums the analyses depend on.

Everything in this module is plain data. The results of the classifiers, taxonomies and
reports are defined by these exact values and by their order, so they are kept together,
in order, and nowhere else. Operators take them as arguments; pass your own to re-aim an
operator at another corpus.
"""

# The closed set of skill categories, in record order.
SKILL_CATEGORIES = ["genai", "ml", "web", "databases", "data", "cloud", "ops", "languages", "domains", "other"]

# The closed set of posting types.
AI_TYPES = ["ai-first", "ml-first", "ai-support", "unknown"]

# The seven columns of a listing card, in file order.
CARD_COLUMNS = ["title", "company", "location", "work_type", "level", "compensation", "link"]

# Title patterns of the ai_first class.
AI_FIRST_PATTERNS = [
    r"\bAI Engineer\b(?!\s*\(?\w*Software)",
    r"\bAI/ML Engineer\b",
    r"\bAI & ML Engineer\b",
    r"\bAI / Machine Learning Engineer\b",
    r"\bAI / ML Engineer\b",
    r"\bAI & ML\b",
    r"\bML Engineer\b",
    r"\bMachine Learning Engineer\b",
    r"\bApplied AI Engineer\b",
    r"\bApplied AI / Machine Learning Engineer\b",
    r"\bApplied AI/ML Engineer\b",
    r"\bGenerative AI Engineer\b",
    r"\bGen AI Engineer\b",
    r"\bGenerative AI / Machine Learning Engineer\b",
    r"\bAI Research Engineer\b",
    r"\bAI Scientist\b",
    r"\bResearch Scientist/Research Engineer\b",
    r"\bAI Developer\b(?!\s+\(.*Software)",
    r"\bAI Application Engineer\b",
    r"\bAI Automation Engineer\b",
    r"\bAI Infrastructure Engineer\b",
    r"\bAI Platform Engineer\b",
    r"\bAI Ops Engineer\b",
    r"\bAI Operations Engineer\b",
    r"\bConversational AI Engineer\b",
    r"\bComputer Vision AI Engineer\b",
    r"\bAI Native Engineer\b",
    r"\bAI Native Software Engineer\b",
    r"\bDistinguished AI Engineer\b",
    r"\bPrincipal AI Engineer\b",
    r"\bAI Principal Engineer\b",
    r"\bAI Data Engineer\b",
    r"\bGen AI Data Engineer\b",
    r"\bFounding AI Engineer\b",
    r"\bStaff AI Engineer\b",
    r"\bSenior AI Engineer\b",
    r"\bLead AI Engineer\b",
    r"\bJunior AI Engineer\b",
    r"\bAI Engineer II\b",
    r"\bAI Engineer 2\b",
    r"\bAI Engineer I\b",
    r"\bFull Stack AI Engineer\b",
    r"\bFullstack AI Engineer\b",
    r"\bAI/ML Full Stack Engineer\b",
    r"\bSenior AI Full-Stack Software Engineer\b",
    r"\bSenior Full-Stack AI Engineer\b",
    r"\bAI & Researcher\b",
    r"\bAI Product & Research Engineer\b",
    r"\bAI Research Engineer - AI Safety\b",
    r"\bAI Research Engineer - Reinforcement Learning\b",
    r"\bAI Research Engineer - Signal Processing\b",
    r"\bAI Research Engineer - Robotics\b",
    r"\bAI/ML Engineer\b",
    r"\bAI ML Engineer\b",
    r"\bAgentic AI\b.*\bEngineer\b",
    r"\bEntrepreneurial AI Research Engineer\b",
    r"\bML/AI Engineer\b",
    "deployment engineer",
    "inference engineer",
    "prompt engineer",
    "agentic artificial intelligence",
    "artificial intelligence engineer",
    "ai scientist",
    "ai researcher",
    "ai safety engineer",
    "ai systems engineer",
    "ai api engineer",
    "ai application developer",
    "ai/ml developer",
    "ai tools engineer",
    "ai innovation engineer",
    "distinguished engineer.*ai",
    "managing engineer.*ai",
    "vice president.*ai.*engineer",
]

# Title patterns of the ai_support class.
AI_SUPPORT_PATTERNS = [
    r"\bSoftware Engineer.*\bAI\b",
    r"\bSoftware Engineer, AI\b",
    r"\bSoftware Engineer \(AI\)",
    r"\bSoftware Engineer - AI\b",
    r"\bSoftware Engineer – AI\b",
    r"\bSenior Software Engineer.*AI\b",
    r"\bStaff Software Engineer.*AI\b",
    r"\bPrincipal Software Engineer.*AI\b",
    r"\bLead Software Engineer.*AI\b",
    r"\bFull Stack Engineer.*\bAI\b(?!\s*Engineer)",
    r"\bFullstack Engineer.*\bAI\b",
    r"\bFull-Stack Engineer.*\bAI\b",
    r"\bBackend Engineer.*\bAI\b",
    r"\bBack-End Engineer.*\bAI\b",
    r"\bFrontend Engineer.*\bAI\b",
    r"\bFront-End Engineer.*\bAI\b",
    r"\bData Engineer.*\bAI\b",
    r"\bData Engineer.*\bML\b",
    r"\bSenior Data Engineer.*\bAI\b",
    r"\bSite Reliability Engineer.*\bAI\b",
    r"\bSenior Site Reliability Engineer.*\bAI\b",
    r"\bDevOps Engineer.*\bAI\b",
    r"\bSenior DevOps Engineer.*\bAI\b",
    r"\bMLOps Engineer\b",
    r"\bAI/ML Ops Engineer\b",
    r"\bSenior AI/ML Ops Engineer\b",
    r"\bProduct Engineer.*\bAI\b",
    r"\bSenior Product Engineer.*\bAI\b",
    r"\bStaff Product Engineer.*\bAI\b",
    r"\bInfrastructure Engineer.*\bAI\b",
    r"\bSenior Infrastructure Engineer.*\bAI\b",
    r"\bPlatform Engineer.*\bAI\b",
    r"\bPlatform Engineer.*\bML\b",
    r"\bSolutions Engineer.*\bAI\b",
    r"\bAI Solutions Engineer\b",
    r"\bSenior AI Solutions Engineer\b",
    r"\bSales Engineer.*\bAI\b",
    r"\bAI Sales Engineer\b",
    r"\bIntegration Engineer.*\bAI\b",
    r"\bQA Engineer.*\bAI\b",
    r"\bQA Automation Engineer.*\bAI\b",
    r"\bTest Engineer.*\bAI\b",
    r"\bAutomation Engineer.*\bAI\b",
    r"\bAI Success Engineer\b",
    r"\bCustomer AI Engineer\b",
    r"\bAI Account Engineer\b",
    r"\bForward Deployed Engineer.*\bAI\b",
    r"\bAI Forward Deployed Engineer\b",
    r"\bAI Software Engineer\b",
    r"\bAI Software Engineer \(",
    r"\bAI Staff Software Engineer\b",
    r"\bStaff Software Engineer.*\bAI\b",
    r"\bSenior/Staff.*\bEngineer.*\bAI\b",
    r"\bStaff.*\bEngineer.*\bAI\b",
    r"\bSenior.*\bEngineer.*\bAI\b",
    r"\bLead.*\bEngineer.*\bAI\b",
    r"\bPrincipal.*\bEngineer.*\bAI\b",
    r"\bStaff Fullstack Engineer.*\bAI\b",
    r"\bStaff Full-Stack Engineer.*\bAI\b",
    r"\bSenior Full Stack Engineer.*\bAI\b",
    r"\bSenior Full-Stack Engineer.*\bAI\b",
    r"\bSenior/Staff Full Stack Engineer.*\bAI\b",
    r"\bLead Full Stack Engineer.*\bAI\b",
    r"\bPrincipal Full Stack Engineer.*\bAI\b",
    r"\bStaff Backend Engineer.*\bAI\b",
    r"\bSenior Backend Engineer.*\bAI\b",
    r"\bLead Backend Engineer.*\bAI\b",
    r"\bStaff Frontend Engineer.*\bAI\b",
    r"\bSenior Frontend Engineer.*\bAI\b",
    r"\bLead Frontend Engineer.*\bAI\b",
    r"\bStaff Systems Engineer.*\bAI\b",
    r"\bSenior Systems Engineer.*\bAI\b",
    r"\bAI-Enabled Software Engineer\b",
    r"\bAI - Enabled Software Engineer\b",
    r"\bFlowFuse Full Stack Developer \(AI-focused\)",
    r"\bFounding Engineer.*\bAI\b",
    r"\bFounding AI Product Engineer\b",
    r"\bFounding AI/Data Engineer\b",
    r"\bFounding Staff AI Engineer\b",
    r"\bFull Stack Engineer \(AI\)",
    r"\bFull Stack Engineer \(Libra",
    r"\bFull Stack Software Engineer.*\bAI\b",
    r"\bFullstack Engineer, Generative AI\b",
    r"\bSenior MLOps Engineer\b",
    r"\bIT Engineer \(AI\b",
    r"\bJava Engineer - AI Enablement\b",
    r"\bPython Engineer - AI\b",
    r"\bKnowledge Graph Engineer / AI Architect\b",
    r"\bSenior Staff.*\bEngineer.*\bAI\b",
    r"\bSr\.\b.*\bEngineer.*\bAI\b",
    r"\bSr\b.*\bEngineer.*\bAI\b",
    "applications engineer",
    "enablement engineer",
    "integrations engineer",
    "product developer",
    "solution engineer",
    "staff engineer.*ai",
    "android developer.*ai",
    "ios developer.*ai",
    "clojure.*ai",
    "consulting.*engineer.*ai",
    "developer relations",
    "apprenticeship",
    "design engineer.*ai",
    "gtm engineer.*ai",
    "workplace engineer.*ai",
    "appsec engineer.*ai",
    "manager.*solutions",
    "customer engineer",
    "quantitative developer.*ai",
    "simulation engineer.*ai",
    "support engineer.*ai",
    "technical operations.*ai",
    "trading.*ai",
    "solutions architecture",
]

# Title patterns of roles outside the field (an optional filter, never part of the classes).
NON_AI_PATTERNS = [
    r"\bAndroid Developer\b",
    r"\biOS Developer\b",
    r"\bSales Engineer\b(?!\s*.*\bAI\b)",
    r"\bSolutions Engineer\b(?!\s*.*\bAI\b)",
    r"\bGTM Engineer\b",
    r"\bProduct Manager\b",
    r"\bVice President\b",
    r"\bManager\b",
    r"\bDirector\b",
    r"\bQA Engineer\b(?!\s*.*\bAI\b)",
    r"\bDevOps Engineer\b(?!\s*.*\bAI\b)",
    r"\bSite Reliability Engineer\b(?!\s*.*\bAI\b)",
]

# Phrases and keywords used by the title classifier after the patterns.
SUPPORT_PHRASES = [
    "full stack engineer", "fullstack engineer", "backend engineer", "frontend engineer",
    "software engineer", "data engineer", "site reliability", "devops",
    "infrastructure engineer", "platform engineer", "solutions engineer", "sales engineer",
    "integration engineer", "qa engineer", "automation engineer", "test engineer",
    "product engineer", "staff engineer",
]
GUARD_TERMS = ["software", "full stack", "fullstack", "backend", "frontend", "data", "staff"]
AI_FIRST_KEYWORDS = [
    "machine learning engineer", "ml engineer", "applied ai engineer", "generative ai engineer",
    "gen ai engineer", "ai research engineer", "conversational ai engineer",
    "computer vision ai engineer", "ai infrastructure engineer", "ai platform engineer",
    "ai ops engineer", "distinguished ai engineer", "principal ai engineer",
    "founding ai engineer", "ai deployment engineer", "ai inference engineer",
    "ai prompt engineer", "ai safety engineer", "artificial intelligence engineer",
]
SOFTWARE_PHRASES = ["software engineer", "full stack", "fullstack", "backend engineer", "frontend engineer"]

# Seniority strings removed from a title, in removal order.
SENIORITY_WORDS = ["senior", "staff", "principal", "lead", "junior", "sr.", "sr", "lead", "iii", "ii", "i"]

# First-match taxonomy of responsibilities, in match order.
RESPONSIBILITY_TAXONOMY = [
    ("Build/Implement Systems", ["build", "implement", "develop", "create", "construct", "design system"]),
    ("Deploy/Production", ["deploy", "production", "serve", "release", "ship", "launch"]),
    ("RAG/Retrieval", ["rag", "retrieval", "knowledge base", "vector", "semantic search"]),
    ("Agents/Agentic", ["agent", "agentic", "autonomous", "copilot", "workflow automation"]),
    ("Fine-tuning/Training", ["fine-tun", "finetun", "train model", "custom model", "lora", "peft"]),
    ("Prompt Engineering", ["prompt", "prompting", "prompt engineer"]),
    ("Evaluation/Testing", ["evaluat", "test", "benchmark", "quality", "measure", "assess"]),
    ("Data/Pipelines", ["data pipeline", "etl", "data engineer", "preprocess", "dataset", "data quality"]),
    ("Infrastructure/Platform", ["platform", "infrastructure", "mlops", "gpu", "cluster", "scalable"]),
    ("API/Integration", ["api", "integrate", "sdk", "library", "interface"]),
    ("Frontend/UI", ["frontend", "ui", "ux", "interface", "dashboard", "chatbot", "web app"]),
    ("Research/Experiment", ["research", "experiment", "novel", "state of the art", "sota", "publish"]),
    ("Customer/Client Work", ["customer", "client", "consult", "stakeholder", "user feedback"]),
    ("Collaboration/Team", ["collaborat", "team", "mentor", "lead", "guide", "work with"]),
    ("Monitor/Maintenance", ["monitor", "maintain", "observ", "incident", "debug", "troubleshoot"]),
    ("Performance/Optimization", ["optim", "performance", "latency", "efficient", "speed", "scale"]),
    ("Security/Safety", ["secur", "safety", "protect", "compliance", "risk"]),
]

# First-match taxonomy of use cases, in match order.
USE_CASE_TAXONOMY = [
    ("Agents / Agentic AI", ["agent", "agentic", "autonomous", "copilot", "assistant"]),
    ("Enterprise deployments", ["enterprise", "business", "organization", "company-wide"]),
    ("Fine-tuning / Custom models", ["fine-tun", "finetun", "custom model", "specialized", "domain-specific"]),
    ("Customer-facing solutions", ["customer", "client", "user-facing", "customer service"]),
    ("RAG / Retrieval", ["rag", "retrieval", "knowledge base", "document"]),
    ("Inference / Serving", ["inference", "serving", "deployment", "production"]),
    ("Evaluation / Testing", ["evaluat", "quality", "testing", "benchmark", "safety"]),
    ("Search / Semantic search", ["search", "semantic", "vector"]),
    ("Chat / Conversational", ["chat", "conversational", "dialog", "messaging"]),
    ("Code generation", ["code generation", "code assistant", "copilot", "developer"]),
    ("Data analysis", ["data analysis", "analytics", "insight", "reporting"]),
    ("Content creation", ["content", "writing", "copy", "marketing"]),
    ("Recommendations", ["recommend", "personalization", "suggest"]),
    ("Document processing", ["document", "pdf", "extract", "summarize"]),
]

# Gated first-match taxonomy of fine-tuning use cases, and its gate keywords.
FINETUNING_TAXONOMY = [
    ("Domain knowledge", ["domain", "industry", "vertical", "medical", "legal", "finance",
                          "healthcare", "scientific", "technical"]),
    ("Company data", ["company", "internal", "proprietary", "organization", "proprietary data"]),
    ("Style/Tone", ["style", "tone", "voice", "brand", "personality", "format"]),
    ("Instruction following", ["instruction", "task", "command", "reasoning", "agent"]),
    ("Language", ["language", "translation", "multilingual", "non-english"]),
    ("Performance", ["faster", "smaller", "efficiency", "latency", "cost", "optimize"]),
    ("Privacy", ["privacy", "on-premise", "local", "offline", "secure"]),
]
FINETUNING_GATE = ["fine-tun", "custom", "specialized"]

# What counts as a mention of fine-tuning, and as a fine-tuning technique.
FINETUNING_KEYWORDS = ["fine-tun", "finetun", "fine tun", "custom model", "specialized model",
                       "domain-specific", "adaptation", "lora", "qlora", "peft", "instruction tuning"]
FINETUNING_INDICATORS = ["fine-tun", "finetun", "lora", "qlora", "peft", "instruction tuning"]
FINETUNING_TITLE_WORDS = ["fine-tune", "finetune"]
FINETUNING_REPEATED = ["fine-tun", "finetun"]
FINETUNING_TECHNIQUES = ["lora", "qlora", "peft"]

# First-match taxonomy of support roles over title or body, in match order.
SUPPORT_ROLE_TAXONOMY = [
    ("Platform/Infrastructure", ["platform", "infrastructure", "infra", "mlops", "kubernetes", "k8s", "deployment"]),
    ("Data/Pipelines", ["data engineer", "data pipeline", "etl", "data platform"]),
    ("Sales/Solutions", ["sales", "solutions", "presales", "customer success"]),
    ("Backend/General SWE", ["backend", "api", "microservices", "internal tools"]),
    ("Frontend/UI", ["frontend", "ui", "ux", "full-stack"]),
    ("SRE/DevOps", ["sre", "site reliability", "devops", "reliability"]),
    ("Observability/Monitoring", ["observability", "monitoring", "evals", "testing"]),
]

# Multi-label tags of use cases.
USE_CASE_TAGS = [
    ("RAG", ["rag", "retrieval"]),
    ("Agents", ["agent", "agentic", "autonomous"]),
    ("Fine-tuning", ["fine-tun", "finetun", "custom", "specialized"]),
    ("Enterprise", ["enterprise", "business"]),
    ("Customer-facing", ["customer", "client"]),
    ("Evaluation", ["evaluat", "quality", "testing"]),
    ("Inference", ["inference", "serving", "deployment"]),
    ("Search", ["search", "semantic"]),
]

# Multi-label title families.
TITLE_FAMILIES = [
    ("Backend", ["backend", "back-end", "back end"]),
    ("Full Stack", ["full stack", "full-stack", "fullstack"]),
    ("Platform", ["platform"]),
    ("Infrastructure", ["infrastructure", "infra"]),
    ("Data Engineer", ["data engineer", "data platform"]),
    ("DevOps/SRE", ["devops", "sre", "site reliability", "reliability"]),
    ("Research", ["research", "scientist"]),
    ("Product", ["product"]),
    ("Solutions", ["solutions"]),
]

# Case-sensitive stage buckets, in match order.
STAGE_BUCKETS = [
    ("Early", ["Seed", "Pre-Seed", "Angel", "Seed/Series A"]),
    ("Growth", ["Series A", "Series B", "Series B+", "Series C", "Series C+"]),
    ("Late", ["Series D", "Series D+", "Series E", "Series E+", "Series F", "Public"]),
]

# Research versus applied indicators.
RESEARCH_INDICATORS = [
    "research", "scientist", "publication", "paper", "novel", "algorithm", "architecture development",
    "model architecture", "training methods", "safety research", "rl research", "reinforcement learning",
    "world model", "control theory", "experimental", "push sota", "state of the art",
]
APPLIED_INDICATORS = [
    "production", "deploy", "shipping", "product", "customer", "enterprise", "api integration",
    "fine-tuning existing", "apply", "implement",
]
RESEARCH_TITLE_WORDS = ["research engineer", "scientist", "research scientist"]

# Skill terms the reports look up as substrings.
ML_TERMS = ["PyTorch", "TensorFlow", "Keras", "JAX", "scikit-learn", "XGBoost", "LightGBM", "fine-tuning",
            "model training", "model evaluation", "embeddings", "deep learning", "machine learning",
            "neural networks", "optimization", "CUDA", "transformers", "huggingface"]
FRONTEND_TERMS = ["react", "vue", "next.js", "frontend", "typescript", "javascript"]
BACKEND_TERMS = ["fastapi", "flask", "django", "api", "graphql", "rest"]
COMPARED_SKILLS = {
    "genai": ["RAG", "prompt engineering", "agents", "LangChain", "LLMs"],
    "ml": ["PyTorch", "TensorFlow", "fine-tuning", "machine learning"],
    "web": ["React", "FastAPI", "TypeScript", "APIs"],
    "ops": ["Docker", "Kubernetes", "CI/CD"],
    "cloud": ["AWS", "Azure", "GCP"],
}

# Skills matched exactly as agent and retrieval frameworks.
FRAMEWORKS = ["LangChain", "LangGraph", "LlamaIndex", "DSPy", "Haystack", "Semantic Kernel", "AutoGen",
              "CrewAI", "Phidata"]

# Terms whose rate in titles is reported.
TITLE_TERMS = ["ai", "machine learning", "ml", "data scientist", "research", "applied", "engineer", "developer",
               "platform", "infrastructure", "product", "solutions", "full-stack", "backend", "frontend", "devops",
               "sre", "agent", "llm", "genai", "generative", "model", "deployment"]

# Entry-level words in titles.
ENTRY_LEVEL_WORDS = ["junior", "entry", "associate", "grad", "intern", "beginner"]

# Words left out of the word frequencies.
RESPONSIBILITY_STOP_WORDS = ["with", "from", "they", "have", "been", "development", "working", "including",
                             "support", "within", "will", "work"]
USE_CASE_STOP_WORDS = ["with", "from", "they", "have", "been", "development", "building", "working", "including",
                       "support", "within"]

# Text that disqualifies a skill pill, and the class words that mark one.
PILL_DENYLIST = ["upload", "apply", "view all"]
PILL_CLASSES = "border|rounded|skill|tag"

# Location words recognised on a card.
LOCATION_WORDS = ["Remote", "Berlin", "Germany", "London", "UK", "US", "Amsterdam", "Paris", "Munich"]

# Experience bands in years and their labels.
LEVEL_BANDS = [(2, "Entry level"), (4, "Mid level"), (7, "Senior level")]
TOP_LEVEL = "Expert/Leader"
