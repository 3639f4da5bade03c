"""Word lists as data: a profile for Chinese manuals and one for Latin text."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LexiconProfile:
    name: str
    weak_terms: tuple[str, ...] = ()
    weak_chars: str = ""
    conservative_terms: tuple[str, ...] = ()
    conservative_chars: str = ""
    whitelisted: tuple[str, ...] = ()
    generic_terms: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = ()
    common_terms: tuple[str, ...] = ()
    operation_intent: tuple[str, ...] = ()
    safety_intent: tuple[str, ...] = ()
    fault_intent: tuple[str, ...] = ()
    action_terms: tuple[str, ...] = ()
    leading_terms: tuple[str, ...] = ()
    generic_notices: tuple[str, ...] = ()
    preface_phrases: tuple[str, ...] = ()
    preface_chapter: str = ""
    notice_words: tuple[str, ...] = ()
    meaning_words: tuple[str, ...] = ()
    short_notice_words: tuple[str, ...] = ()
    safety_markers: tuple[str, ...] = ()
    action_markers: tuple[str, ...] = ()
    entity_markers: tuple[str, ...] = ()
    toc_heading: str = ""
    toc_titles: tuple[str, ...] = ()
    warning: str = ""
    caution: str = ""
    note: str = ""
    warning_light: tuple[str, ...] = ()
    high_risk: tuple[str, ...] = ()
    medium_risk: tuple[str, ...] = ()
    procedure_phrases: tuple[str, ...] = ()
    operation_verbs: tuple[str, ...] = ()
    chapters: tuple[str, ...] = ()
    sections: tuple[str, ...] = ()
    subsections: tuple[str, ...] = ()
    list_intro: tuple[str, ...] = ()
    reject_terms: tuple[str, ...] = ()
    body_tone: tuple[str, ...] = ()
    action_prefixes: tuple[str, ...] = ()
    title_suffixes: tuple[str, ...] = ()
    reject_titles: tuple[str, ...] = ()


# Lists, markers and phrases that results depend on. Section
# titles belong to one manual and are a parameter (`sections`).
ZH_MANUAL = LexiconProfile(
    name="zh_manual",
    weak_terms=("如何", "怎么", "哪些", "什么", "是否", "需要", "应该", "可以", "进行", "情况", "时候", "请", "有哪些"),
    weak_chars="如何怎么哪些什需要应该可以进行情况时候请有后前办",
    conservative_terms=("注意", "注意事项", "使用", "操作", "车辆"),
    conservative_chars="注意事项车辆使用操作",
    whitelisted=("安全", "报警", "检查", "正确", "驾驶"),
    generic_terms=("如何", "怎么", "哪些", "什么", "是否", "需要", "应该", "可以", "进行", "情况", "时候", "请", "有哪些", "注意", "注意事项", "使用", "操作", "车辆", "事项"),
    stopwords=("如何", "怎么", "什么", "哪些", "需要", "应该", "可以", "车辆", "使用", "进行", "之后", "如果", "是否", "的", "了", "和", "与", "在", "后", "前", "时"),
    common_terms=("涉水驾驶", "胎压报警", "安全带", "儿童锁", "充电安全", "高压系统", "制动系统", "转向助力", "外部车灯"),
    operation_intent=("如何", "怎么", "步骤", "使用", "启用", "打开", "关闭", "检查", "调节", "设置"),
    safety_intent=("安全", "注意事项", "警告", "禁止", "不得", "风险"),
    fault_intent=("报警", "故障", "警告灯", "指示灯"),
    action_terms=("检查", "注意", "警告", "禁止", "必须", "应", "请"),
    leading_terms=("如下", "下列", "以下", "检查", "注意"),
    generic_notices=("注意事项", "注意事项：", "警告", "警告！", "注意", "注意！", "说明", "说明！"),
    preface_phrases=("在使用车辆时，请时刻遵循以下注意事项", "在使用车辆时，请时刻遵循以下注意事项。"),
    preface_chapter="前言",
    notice_words=("警告", "注意", "说明"),
    meaning_words=("表示", "含义", "用于"),
    short_notice_words=("注意事项", "说明", "警告", "注意"),
    safety_markers=("警告！", "警告:", "警告：", "禁止", "不得", "切勿", "生命危险", "人身伤害"),
    action_markers=("按下", "拉出", "插入", "转动", "检查", "启用", "关闭", "打开", "调节", "锁扣", "锁舌"),
    entity_markers=("安全带", "胎压", "涉水", "充电", "充电枪", "充电口", "儿童锁", "制动", "高压", "气囊", "警告灯", "锁扣", "锁舌"),
    toc_heading="目录",
    toc_titles=("目录", "目 录"),
    warning="警告",
    caution="注意",
    note="说明",
    warning_light=("警告灯", "警告图标", "警告信息"),
    high_risk=("警告！", "生命危险", "人身伤害", "高压触电", "触电", "高压线缆", "安全气囊", "气囊", "制动失效", "充电安全", "禁止", "不得", "切勿", "儿童单独留在车内"),
    medium_risk=("注意", "车辆损坏", "胎压", "涉水", "保养", "故障灯", "警告灯", "检查"),
    procedure_phrases=("操作步骤", "执行下列", "请按以下", "按以下"),
    operation_verbs=("按下", "拉出", "插入", "转动", "检查", "启用", "关闭", "打开", "调节", "选择", "点击", "缓慢拉出", "锁舌", "锁扣", "腰部安全带", "肩部安全带", "插入锁扣", "拉紧"),
    chapters=("前言", "用车前准备", "装载货物", "上车和下车", "驾驶前的准备", "仪表和灯光", "安全出行", "启动和驾驶", "驾驶辅助", "泊车", "空调", "中央显示屏", "高压系统", "保养和维护", "OTA升级", "紧急情况下", "技术资料"),
    subsections=("EPB AUTO功能", "熄火时解除电子驻车制动（EPB）"),
    list_intro=("下列检查", "以下检查", "执行下列", "注意以下事项", "应注意以下事项", "包括以下", "如下"),
    reject_terms=("应", "请", "需要", "建议", "可以", "确保", "检查", "注意以下", "下列", "如下", "以下", "点击"),
    body_tone=("请", "应", "如果", "当", "为了", "确保", "建议", "可以", "需要", "位于"),
    action_prefixes=("使用", "打开", "关闭", "开启", "启用", "释放", "检查", "保养", "维护", "更换", "调节", "连接", "断开", "清洁", "加油"),
    title_suffixes=("系统", "功能", "设备", "装置", "工具", "警告", "安全警告", "冲洗", "清洗", "维护", "保养", "车灯", "雨刮片", "轮辋", "前机舱盖"),
    reject_titles=("说明", "警告", "注意", "欢迎"),
)

LATIN_GENERIC = LexiconProfile(
    name="latin_generic",
    weak_terms=("the", "of", "and", "to", "in", "is", "a"),
    conservative_terms=("this", "that", "with", "for"),
    generic_terms=("the", "of", "and", "to", "in", "is", "a", "this", "that", "with", "for"),
    stopwords=("the", "and", "with", "that", "this", "for"),
    operation_intent=("how", "ing"),
    safety_intent=("was", "not"),
    fault_intent=("err", "fault"),
    action_terms=("are", "be"),
    leading_terms=("the", "this"),
    generic_notices=("note", "warning"),
    notice_words=("note",),
    meaning_words=("means",),
    short_notice_words=("note", "warning"),
    safety_markers=("Warning",),
    action_markers=("ing",),
    entity_markers=("tion",),
    toc_heading="Contents",
    toc_titles=("Contents",),
    warning="The",
    caution="In",
    note="Of",
    warning_light=("Thea",),
    high_risk=("worthless", "token", "password"),
    medium_risk=("tionth", "hesh"),
    procedure_phrases=("as follows",),
    operation_verbs=("oning", "ering", "anes", "oreat"),
)
