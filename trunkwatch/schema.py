"""Table schemas and fixed values.

Everything listed under a "fixed values" comment has to equal what existing
users of these tables see today; nothing here is tunable.
"""

from pyspark.sql import types as T

_s, _l, _i, _d, _b = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType())

PIPELINES = T.StructType([
    T.StructField("pipeline_id", _s),
    T.StructField("name", _s),
    T.StructField("length_km", _i),
    T.StructField("diameter_mm", _i),
    T.StructField("start_point", _s),
    T.StructField("end_point", _s),
    T.StructField("year_built", _i),
    T.StructField("operator", _s),
])

OBJECTS = T.StructType([
    T.StructField("object_id", _l),
    T.StructField("object_name", _s),
    T.StructField("object_type", _s),
    T.StructField("pipeline_id", _s),
    T.StructField("lat", _d),
    T.StructField("lon", _d),
    T.StructField("year", _i),
    T.StructField("material", _s),
])

DIAGNOSTICS = T.StructType([
    T.StructField("diag_id", _l),
    T.StructField("object_id", _l),
    T.StructField("method", _s),
    T.StructField("date", _s),
    T.StructField("temperature", _d),
    T.StructField("humidity", _d),
    T.StructField("illumination", _d),
    T.StructField("defect_found", _b),
    T.StructField("defect_description", _s),
    T.StructField("quality_grade", _s),
    T.StructField("param1", _d),
    T.StructField("param2", _d),
    T.StructField("param3", _d),
    T.StructField("ml_label", _s),
])

IMPORT_LOG = T.StructType([
    T.StructField("run_id", _s),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("table_name", _s),
    T.StructField("file", _s),
    T.StructField("status", _s),
    T.StructField("rows", _l),
    T.StructField("errors", T.ArrayType(_s)),
    T.StructField("version", _s),
])

ALERT_EVENTS = T.StructType([
    T.StructField("alert_id", _s),
    T.StructField("action", _s),
    T.StructField("event_at", T.TimestampType()),
    T.StructField("message", _s),
    T.StructField("type", _s),
    T.StructField("metadata", T.MapType(_s, _s)),
])

# --- fixed values: columns an import must have --------------------------------
REQUIRED_AT_IMPORT = {
    "objects": ["object_id", "object_name", "object_type", "pipeline_id", "lat", "lon"],
    "diagnostics": ["diag_id", "object_id", "method", "date", "defect_found"],
}
REQUIRED_AT_STARTUP = {
    "objects": ["object_id", "object_name", "pipeline_id", "lat", "lon"],
    "diagnostics": ["diag_id", "object_id", "method", "date"],
}

# --- fixed values: code lists -------------------------------------------------
OBJECT_TYPES = ["crane", "compressor", "pipeline_section"]
METHODS_AT_IMPORT = ["VIK", "UZK", "MFL", "TFI", "GEO", "MPK", "PVK", "RGK",
                     "TVK", "VIBRO", "UTWM", "AE", "TOFD"]
METHODS_AT_STARTUP = ["VIK", "PVK", "MPK", "UZK", "RGK", "TVK", "VIBRO", "MFL",
                      "TFI", "GEO", "UTWM"]
CRITICAL_METHODS = ["UZK", "RGK", "MFL", "UTWM", "TFI"]
QUALITY_GRADES = ["удовлетворительно", "допустимо", "требует_мер", "недопустимо"]
RISK_LABELS = ["normal", "medium", "high"]
OBJECT_TYPE_NAMES = {
    "crane": "Crane",
    "compressor": "Compressor",
    "pipeline_section": "Pipeline Section",
}

# --- fixed values: forecast texts ---------------------------------------------
MSG_INSUFFICIENT = "Недостаточно данных для прогноза (нужно минимум 3 обследования)"
MSG_NO_DEFECT = "Объект в хорошем состоянии. Плановое обследование через год."
MSG_ONE_DEFECT = "Обнаружен дефект. Рекомендуется повторное обследование через 6 месяцев."
MSG_HIGH = "🚨 ВЫСОКИЙ РИСК! Требуется срочное обследование"
MSG_MEDIUM = "⚠️ Средний риск. Требуется внеплановое обследование"
MSG_LOW = "✅ Низкий риск. Плановое обследование"
MSG_NO_OBJECTS = "Нет объектов на этом трубопроводе"
MSG_NO_DIAGNOSTICS = "Нет данных диагностик для этого трубопровода"
ADVICE_REPAIR = "🚨 Требуется масштабная программа ремонтов и замен"
ADVICE_ATTENTION = "⚠️ Необходимо усиленное внимание и внеплановые обследования"
ADVICE_REGULAR = "📊 Штатный режим эксплуатации с регулярным мониторингом"
ADVICE_GOOD = "✅ Трубопровод в хорошем состоянии"

# --- fixed values: report texts (printf-style) --------------------------------
LINE_HIGH = "Требуется немедленное внимание к %d объектам с высоким риском"
LINE_MEDIUM = "Необходим план мероприятий для %d объектов со средним риском"
LINE_DEFECT_RATE = "Высокий процент дефектности (%s%%) требует системного анализа"
LINE_CONTINUE = "Продолжить регулярные обследования согласно графику"
LINE_METHODS = "Рассмотреть применение дополнительных методов контроля для критичных участков"
STATUS_ATTENTION = "Требует внимания"
STATUS_NORMAL = "В норме"

# --- fixed values: screen labels ----------------------------------------------
BAND_HIGH, BAND_MEDIUM, BAND_LOW = "Высокий", "Средний", "Низкий"
TREND_WORSE, TREND_BETTER, TREND_STABLE = "Ухудшение", "Улучшение", "Стабильно"
AGE_NOW, AGE_MINUTES, AGE_HOURS, AGE_DAYS = "только что", "%d мин назад", "%d ч назад", "%d дн назад"

# --- fixed values: alert texts (printf-style) ---------------------------------
ALERT_DEFECT = "Обнаружен дефект на трубопроводе %s, объект %s"
ALERT_SUFFIX_HIGH = " (КРИТИЧЕСКИЙ УРОВЕНЬ РИСКА)"
ALERT_SUFFIX_MEDIUM = " (средний уровень риска)"
ALERT_OBJECTS_IMPORTED = "Импортировано %d объектов из %s"
ALERT_DIAGNOSTICS_IMPORTED = "Импортировано %d диагностик из %s. ML модель переобучена."
ALERT_IMPORT_FAILED = "Ошибка импорта %s: %s"
ALERT_REPORT = "Отчет (%s) для трубопровода %s успешно создан"
ALERT_TRAINING = "ML модель обучена. Точность: %.2f%%, признаков: %d"

# --- fixed values: import messages (printf-style) -----------------------------
ERR_MISSING_COLUMNS = ("❌ Отсутствуют обязательные колонки: %s\n"
                       "📋 Найденные колонки в файле: %s\n"
                       "💡 Скачайте шаблон и проверьте названия колонок (регистр важен!)")
ERR_DUPLICATES = "Дублирующиеся %s: [%s]"
ERR_LATITUDE = "Некорректные значения широты (должны быть от -90 до 90)"
ERR_LONGITUDE = "Некорректные значения долготы (должны быть от -180 до 180)"
ERR_ORPHANS = "Ссылки на несуществующие object_id: [%s]"
ERR_READ = "Критическая ошибка: %s"
WARN_TYPES = "Неизвестные типы объектов"
WARN_METHODS = "Неизвестные методы"
WARN_GRADES = "Неизвестные оценки качества"
WARN_LABELS = "Неизвестные метки ML"
WARN_NULLS = "Колонка '%s' содержит %d пустых значений"
WARN_DATES = "Некорректных дат: %d"
WARN_DEPTH = "У дефектов отсутствует param1: %d записей"

# not a fixed value: values that were lost in a batch go unnoticed otherwise
WARN_UNREADABLE = "Колонка '%s' содержит %d нечитаемых значений"

# --- fixed values: Cyrillic to Latin ------------------------------------------
LATIN = {
    "А": "A", "Б": "B", "В": "V", "Г": "G", "Д": "D", "Е": "E", "Ё": "Yo",
    "Ж": "Zh", "З": "Z", "И": "I", "Й": "Y", "К": "K", "Л": "L", "М": "M",
    "Н": "N", "О": "O", "П": "P", "Р": "R", "С": "S", "Т": "T", "У": "U",
    "Ф": "F", "Х": "Kh", "Ц": "Ts", "Ч": "Ch", "Ш": "Sh", "Щ": "Shch",
    "Ъ": "", "Ы": "Y", "Ь": "", "Э": "E", "Ю": "Yu", "Я": "Ya",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo",
    "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch",
    "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
    "№": "No.", "—": "-", "–": "-",
}

# --- fixed values: classifier inputs, in order --------------------------------
FEATURES = [
    "param1", "param2", "param3", "quality_score", "defect_found",
    "defect_area", "defect_volume", "is_critical_method",
    "temp_normalized", "humidity_normalized", "illumination_normalized",
    "depth_to_area_ratio", "shape_index", "is_deep_defect", "is_large_defect",
]
