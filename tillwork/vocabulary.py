"""Words, patterns, labels and texts that results depend on."""

# --- number texts -----------------------------------------------------------
CURRENCY_WORDS = ["MZN", "MT", "USD", "EUR", "mzn", "mt", "usd", "eur"]

# Cells that a CSV source may use for "missing".
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Characters that count as surrounding white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"

# --- column headers ---------------------------------------------------------
# Standard field names with the words that point at them, in the order they are tried.
FIELD_WORDS = {
    "data": [
        "data", "date", "fecha", "dt", "dia", "day", "periodo", "period",
        "data_venda", "data venda", "sale date", "transaction date", "data_transacao",
    ],
    "quantidade": [
        "quantidade", "quantity", "qty", "qtd", "qtde", "unidades", "units",
        "amount", "count", "volume", "num", "numero",
    ],
    "valor": [
        "valor", "value", "total", "preco", "price", "revenue", "receita",
        "montante", "subtotal", "gross", "net",
        "total_venda", "total venda", "sale value", "faturacao",
        "faturacao_total", "faturacao total",
    ],
}
REQUIRED_FIELDS = ["data", "valor"]

# Role words used once the standard names are in place.
DATE_ROLE_WORDS = ["data", "date"]
TOTAL_ROLE_WORDS = ["total", "revenue", "faturac", "valor"]
QUANTITY_ROLE_WORDS = ["qtd", "quant", "qty"]
PRICE_ROLE_WORDS = ["prec", "price"]
ORDER_ROLE_NAMES = ["id", "fatura", "recibo", "order_id", "invoice"]
GOODS_WORDS = ["prod", "item", "mercador", "artigo", "sku"]
SERVICE_WORDS = [
    "servic", "descri", "obra", "tarefa", "activid", "activ",
    "servico", "prestac", "trabalho", "job", "tipo_serv",
]

# --- clients ----------------------------------------------------------------
SERVICE_TYPES = ["servicos", "servico"]
GOODS_TYPES = ["retalho", "agropecuaria"]
DEFAULT_BUSINESS_TYPE = "retalho"
DEFAULT_CADENCE = "semanal"
BUSINESS_TYPE_CODES = {"1": "servicos", "2": "retalho", "3": "agropecuaria", "4": "outro"}
CADENCE_CODES = {"1": "diario", "2": "semanal", "3": "mensal"}
FILE_FORMATS = ["csv", "xlsx", "xls", "pdf"]

# --- chat commands ----------------------------------------------------------
GREETINGS = ["ola", "olá", "oi", "hello", "hi", "bom dia", "boa tarde", "boa noite"]
FIRST_CONTACT_GREETINGS = GREETINGS + ["novo"]
COMMANDS = {
    "greeting": GREETINGS,
    "report": ["relatorio", "relatório", "2"],
    "summary": ["resumo", "rapido", "rápido", "3"],
    "top": ["top", "top cinco", "top 5", "4"],
    "sales": ["vendas", "5"],
    "cadence": ["frequencia", "frequência", "6"],
}
CANCEL = "cancelar"
MODE_SALES = "aguardar_vendas"
MODE_CADENCE = "aguardar_frequencia"

# --- report texts -----------------------------------------------------------
GOODS_LABELS = {
    "items_sold": "ITENS VENDIDOS",
    "avg_ticket": "TICKET MEDIO",
    "best_day": "MELHOR DIA",
    "top_title": "Analise de Escoamento e Mix (Top 5)",
    "top_item": "Produto Lider",
    "top_rank": "Ranking",
    "top_quantity": "Qtd Vendida",
    "top_share": "% Relevancia Comercial",
    "top_none": "Nenhum produto detectado",
    "item_of_day": "PRODUTO DO DIA",
    "insight_item": "produto",
    "insight_action": (
        "Este produto lidera em volume de saida no periodo. Cruza este dado com a tua "
        "margem actual: se a margem for baixa, o volume alto pode estar a mascarar um "
        "problema de rentabilidade. Se a margem for saudavel, usa este historico de "
        "procura para negociar melhor preco com o fornecedor. Considera tambem associar "
        "este produto lider a itens de menor rotacao para aumentar o valor medio por "
        "transaccao sem precisar de captar novos clientes."
    ),
    "summary_items": "Itens vendidos",
    "summary_ticket": "Ticket médio",
    "summary_item_of_day": "Produto do dia",
    "plural": "produtos",
}
SERVICE_LABELS = {
    "items_sold": "TRANSACCOES",
    "avg_ticket": "VALOR MEDIO POR SERVICO",
    "best_day": "MELHOR DIA",
    "top_title": "Analise de Servicos Prestados (Top 5)",
    "top_item": "Servico",
    "top_rank": "Ranking",
    "top_quantity": "Ocorrencias",
    "top_share": "% Relevancia",
    "top_none": "Nenhum servico detectado",
    "item_of_day": "SERVICO DO DIA",
    "insight_item": "servico",
    "insight_action": (
        "Este servico lidera em volume de ocorrencias e representa a principal fonte "
        "de receita do periodo. Verifica se tens capacidade operacional para manter "
        "este ritmo sem comprometer a qualidade da entrega. Identifica os clientes que "
        "mais o contratam e contacta-os para renovacao antecipada ou contrato trimestral "
        "com valor fixo. Usa este dado para a proxima conversa comercial: tens historico "
        "concreto para negociar com confianca."
    ),
    "summary_items": "Transacções",
    "summary_ticket": "Valor médio/serviço",
    "summary_item_of_day": "Serviço do dia",
    "plural": "serviços",
}
REVENUE_LABEL = "FATURACAO TOTAL"
PEAK_HOUR_LABEL = "HORA DE PICO"
CHANGE_LABEL = "VARIACAO VS ONTEM"
INSIGHT_PREFIX = "Recomendacao de Gestao: "
INSIGHT_NO_DATA = (
    "Volume analitico insuficiente para este periodo. "
    "Assegura que os registos do periodo estao completos e exporta novamente o ficheiro."
)
INSIGHT_LEADER = "O {item} {leader} lidera o periodo em volume. {action}"
SUMMARY_MONTH, SUMMARY_DAY, SUMMARY_WEEK = "Resumo do Mês (", "Resumo de hoje (", "Resumo da semana:"
SUMMARY_REVENUE, SUMMARY_DAY_REVENUE = "Faturação total: ", "Faturação: "
SUMMARY_TRANSACTIONS, SUMMARY_BEST_DAY = "Transacções: ", "Melhor dia: "
SUMMARY_PEAK_HOUR, SUMMARY_CHANGE = "Hora de pico: ", "Vs ontem: "
AGAINST_YESTERDAY, OF_TOP, OF_TOTAL = " vs ontem", "% do Top 5", "% do total"
UNITS, UNITS_OF_ITEM, COUNT_UNITS, OCCURRENCES = " un . ", " un)", " oc.", " ocorrências"
TOP_HEADING = "Top 5 "
TOP_NONE, TOP_NONE_END = "Não foi possível identificar ", " no teu ficheiro."
MONTH_OF, WEEK_UNTIL = "Mes de ", "Semana Comercial ate "
DAY_HEADING, PERIOD_UNTIL, REPORT_NAME_END = "Relatorio Diario - ", "Periodo Comercial ate ", "_estrategico"

# --- chat texts -------------------------------------------------------------
UNNAMED = "Cliente"
REMINDER = "Ola %s! Ainda nao recebi os teus dados. Envia o ficheiro para receberes o teu relatorio!"
UNREAD_SALES = "Não consegui ler as vendas. Usa o formato:\nproduto, quantidade, valor\n\nExemplo:\nFrango, 3, 250"
UNREAD_SERVICES = "Não consegui ler os serviços. Usa o formato:\nserviço, quantidade, valor\n\nExemplo:\nConsultoria, 1, 5000"
