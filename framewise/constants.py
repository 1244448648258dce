"""Label domains, thresholds and lookup tables the results depend on."""

# Label domains.
SIZE_ORDER = ["extreme_close_up", "close_up", "medium", "full", "wide"]
ANGLE_ORDER = ["low", "eye", "high", "overhead"]
ANGLES = ["low", "eye", "high", "overhead", "dutch"]
MOTIONS = ["static", "pan", "tilt", "dolly_in", "dolly_out", "zoom_in", "zoom_out",
           "truck_left", "truck_right", "pedestal", "orbit", "tracking", "handheld"]
COMPOSITIONS = ["center", "thirds", "symmetry", "leading_space"]

# Body height on screen that still counts as the size label.
SIZE_LIMITS = [("wide", 0.45), ("full", 1.3), ("medium", 2.8), ("close_up", 5.5)]

# Fixed values per shot size.
FOCUS_RATIO = {"extreme_close_up": 0.92, "close_up": 0.88, "medium": 0.72, "full": 0.5, "wide": 0.5}
VISIBLE_RATIO = {"extreme_close_up": 0.12, "close_up": 0.22, "medium": 0.5, "full": 1.0, "wide": 1.0}
LENS_MM = {"extreme_close_up": 85.0, "close_up": 65.0, "medium": 50.0, "full": 40.0, "wide": 28.0}
DEFAULT_FRACTION = {"extreme_close_up": 1.0, "close_up": 0.95, "medium": 0.95, "full": 0.85, "wide": 0.35}
SENSOR_WIDTH_MM = 36.0

# Alignment scoring.
MATCH_OFFSET = 0.55
SKIP_SHOT = 0.1
SKIP_REQUEST = 0.6

# Partial credit between related camera motions.
RELATED_MOTIONS = [
    ("dolly_in", "zoom_in", 0.6), ("dolly_out", "zoom_out", 0.6), ("pan", "tracking", 0.5),
    ("pan", "tilt", 0.4), ("orbit", "tracking", 0.5), ("orbit", "pan", 0.4), ("static", "handheld", 0.2),
]

# Phrase patterns, first match in list order wins.
SIZE_PATTERNS = [
    (r"익스트림\s*클로즈|초근접|초접사|extreme[\s-]*close|\becu\b|눈만|입만", "extreme_close_up"),
    (r"클로즈\s*업|얼굴|close[\s-]*up|\bcu\b", "close_up"),
    (r"미디엄|바스트|상반신|허리\s*위|medium|waist|bust", "medium"),
    (r"와이드|롱\s*샷|원경|설정\s*샷|wide|establishing|long[\s-]*shot", "wide"),
    (r"풀\s*샷|전신|full[\s-]*(shot|body)", "full"),
]
ANGLE_PATTERNS = [
    (r"부감|탑\s*뷰|버드\s*아이|수직으로\s*내려|overhead|top[\s-]*down|bird'?s?[\s-]*eye", "overhead"),
    (r"로우\s*앵글|아래에서\s*올려|올려\s*다|low[\s-]*angle|worm'?s?[\s-]*eye", "low"),
    (r"하이\s*앵글|위에서\s*내려|내려\s*다|high[\s-]*angle", "high"),
    (r"눈\s*높이|아이\s*레벨|eye[\s-]*level", "eye"),
]
MOTION_PATTERNS = [
    (r"돌리\s*인|다가가|다가오|밀고\s*들어|push[\s-]*in|dolly[\s-]*in", "dolly_in"),
    (r"돌리\s*아웃|멀어지|물러나|pull[\s-]*(out|back)|dolly[\s-]*out", "dolly_out"),
    (r"줌\s*인|zoom[\s-]*in", "zoom_in"),
    (r"줌\s*아웃|zoom[\s-]*out", "zoom_out"),
    (r"핸드\s*헬드|흔들리|들고\s*찍|handheld|hand[\s-]*held|shaky", "handheld"),
    (r"궤도|돌아가며|돌면서|주위를\s*돌|오비트|orbit|arc[\s-]*shot", "orbit"),
    (r"트래킹|따라가|따라\s*움직|tracking|follow", "tracking"),
    (r"틸트|tilt", "tilt"),
    (r"패닝|팬\s*(으로|샷|해|하)|훑|\bpan\b|panning", "pan"),
    (r"고정\s*(샷|카메라)|움직이지\s*않|static|locked[\s-]*off", "static"),
]
PEOPLE_PATTERNS = [
    (r"어깨\s*너머|오버\s*숄더|over[\s-]*the[\s-]*shoulder|\bots\b", "ots"),
    (r"투\s*샷|두\s*사람|두\s*명|2\s*인|둘이|마주|대화|two[\s-]*shot|two\s*people|dialogue|conversation", "2"),
    (r"군중|여러\s*명|(?<!마)무리|그룹|crowd|group", "3"),
    (r"혼자|단독|한\s*명|홀로|\bsolo\b|alone|single", "1"),
]
# Connectives between clauses, particles and stop words.
SPLIT_PATTERN = (
    r"->|→|⇒|,|，|;|\bthen\b|\bfinally\b|\bafter\s+that\b|그리고|그\s*다음|다음(?:에|은)?|이어서|이후|뒤에|후에|"
    r"마지막(?:에|으로|은)?|(?:으로|로)\s*시작(?:해서|해|하고)?|시작해서|하다가|했다가|다가(?![가오])|하고")
PARTICLES = r"(으로|에서|에게|하며|하고|해서|까지|부터|이랑|에|은|는|이|가|을|를|과|와|로|의|도)$"
STOPWORDS = ["마무리", "시작", "그리고", "다음", "마지막", "장면", "카메라", "촬영", "영상",
             "the", "and", "with", "shot", "then", "to", "in", "of", "finally", "into", "from",
             "끝", "끝나", "서있", "있다"]

# Sources whose licence allows keeping a copy.
ALLOWED_DOMAINS = ["pexels.com", "pixabay.com", "archive.org", "wikimedia.org"]

# Height of each keypoint as a share of the body (0 feet, 1 crown).
KEYPOINT_RATIO = {0: 0.925, 1: 0.94, 2: 0.94, 3: 0.935, 4: 0.935, 5: 0.83, 6: 0.83,
                  11: 0.53, 12: 0.53, 13: 0.285, 14: 0.285, 15: 0.045, 16: 0.045}
UPPER_KEYPOINTS = [0, 1, 2, 3, 4, 5, 6]
HIP_AND_LOWER = [11, 12, 13, 14, 15, 16]
LOWER_KEYPOINTS = [13, 14, 15, 16]
WIDTH_RATIO = {"shoulder_width": 0.21, "ear_width": 0.085}
WIDTH_CLAMP = (0.75, 2.0)
EYE_RATIO = 0.036

# Limits of the motion quality review.
QUALITY_LIMITS = {"worst_segment_deg": 15.0, "motion_deviation_deg": 6.0, "foot_clearance_error": 0.06,
                  "contact_mismatch": 0.25, "finger_worst_deg": 25.0, "twist_ratio_error": 0.5}
CONTACT_HEIGHT = 0.08

# Chains a rig must have.
REQUIRED_CHAINS = ["Spine", "LeftArm", "RightArm", "LeftLeg", "RightLeg"]

# Bone name tokens of the auxiliary classes.
TWIST_TOKENS = ["twist", "roll", "torsion"]
FINGER_TOKENS = ["thumb", "index", "middle", "ring", "pinky", "little"]
FACE_TOKENS = ["jaw", "eye", "brow", "lid", "lip", "mouth", "cheek", "nose", "tongue"]

# Body segments, ground joints and the chain that gives the body scale.
SEGMENTS = [
    ("LeftThigh", "LeftCalf"), ("LeftCalf", "LeftFoot"), ("RightThigh", "RightCalf"), ("RightCalf", "RightFoot"),
    ("LeftUpperArm", "LeftLowerArm"), ("LeftLowerArm", "LeftHand"),
    ("RightUpperArm", "RightLowerArm"), ("RightLowerArm", "RightHand"), ("Pelvis", "Spine"), ("Neck", "Head"),
]
GROUND_ROLES = ["LeftFoot", "RightFoot"]
SCALE_CHAIN = ["Pelvis", "LeftThigh", "LeftCalf", "LeftFoot"]
FINGER_NAMES = ["Thumb", "Index", "Middle", "Ring", "Pinky"]

# Body roles in order: name, name tokens, parent role, zone, side (-1 left, 1 right), required.
ROLE_SPECS = [
    ("Root", ["root", "reference", "rootnode"], "", "Root", 0, True),
    ("Pelvis", ["pelvis", "hips", "hip", "rigpelvis"], "Root", "Pelvis", 0, True),
    ("Spine", ["spine", "chest", "torso", "rigspine1"], "Pelvis", "CenterUpper", 0, True),
    ("Neck", ["neck", "rigneck1"], "Spine", "CenterUpper", 0, False),
    ("Head", ["head", "righead"], "Spine", "Head", 0, True),
    ("LeftClavicle", ["clavicle_l", "leftshoulder", "shoulder_l", "l_clavicle", "riglarmcollarbone"], "Spine", "Arm", -1, False),
    ("LeftUpperArm", ["upperarm_l", "leftarm", "l_upperarm", "riglarm1", "flleg1", "lfrontleg1", "llegfront1", "frontupleg_l"],
     "Spine", "Arm", -1, True),
    ("LeftLowerArm", ["lowerarm_l", "leftforearm", "forearm_l", "l_forearm", "riglarm2", "flleg2", "lfrontleg2", "llegfront2",
                      "frontlowleg_l"], "LeftUpperArm", "Arm", -1, True),
    ("LeftHand", ["hand_l", "lefthand", "l_hand", "riglarmpalm", "fllegankle", "lfrontlegankle", "llegfrontankle", "frontfoot_l"],
     "LeftLowerArm", "Hand", -1, True),
    ("RightClavicle", ["clavicle_r", "rightshoulder", "shoulder_r", "r_clavicle", "rigrarmcollarbone"], "Spine", "Arm", 1, False),
    ("RightUpperArm", ["upperarm_r", "rightarm", "r_upperarm", "rigrarm1", "frleg1", "rfrontleg1", "rlegfront1", "frontupleg_r"],
     "Spine", "Arm", 1, True),
    ("RightLowerArm", ["lowerarm_r", "rightforearm", "forearm_r", "r_forearm", "rigrarm2", "frleg2", "rfrontleg2", "rlegfront2",
                       "frontlowleg_r"], "RightUpperArm", "Arm", 1, True),
    ("RightHand", ["hand_r", "righthand", "r_hand", "rigrarmpalm", "frlegankle", "rfrontlegankle", "rlegfrontankle", "frontfoot_r"],
     "RightLowerArm", "Hand", 1, True),
    ("LeftThigh", ["thigh_l", "leftupleg", "l_thigh", "riglleg1", "blleg1", "lbackleg1", "llegback1", "backupleg_l"],
     "Pelvis", "Leg", -1, True),
    ("LeftCalf", ["calf_l", "leftleg", "shin_l", "l_calf", "riglleg2", "blleg2", "lbackleg2", "llegback2", "backlowleg_l"],
     "LeftThigh", "Leg", -1, True),
    ("LeftFoot", ["foot_l", "leftfoot", "l_foot", "ankle_l", "rigllegankle", "rigllegfoot1", "bllegankle", "lbacklegankle",
                  "llegbackankle", "backfoot_l"], "LeftCalf", "Foot", -1, True),
    ("RightThigh", ["thigh_r", "rightupleg", "r_thigh", "rigrleg1", "brleg1", "rbackleg1", "rlegback1", "backupleg_r"],
     "Pelvis", "Leg", 1, True),
    ("RightCalf", ["calf_r", "rightleg", "shin_r", "r_calf", "rigrleg2", "brleg2", "rbackleg2", "rlegback2", "backlowleg_r"],
     "RightThigh", "Leg", 1, True),
    ("RightFoot", ["foot_r", "rightfoot", "r_foot", "ankle_r", "rigrlegankle", "rigrlegfoot1", "brlegankle", "rbacklegankle",
                   "rlegbackankle", "backfoot_r"], "RightCalf", "Foot", 1, True),
]
ROLE_NAMES = [s[0] for s in ROLE_SPECS]
PAIRED_ROLES = [("Left" + p, "Right" + p) for p in ("Clavicle", "UpperArm", "LowerArm", "Hand", "Thigh", "Calf", "Foot")]
ROLE_AXES = [["Pelvis", "Spine", "Neck", "Head"],
             ["LeftClavicle", "LeftUpperArm", "LeftLowerArm", "LeftHand"],
             ["RightClavicle", "RightUpperArm", "RightLowerArm", "RightHand"],
             ["LeftThigh", "LeftCalf", "LeftFoot"], ["RightThigh", "RightCalf", "RightFoot"]]
ROLE_FALLBACK = {"LeftClavicle": "LeftUpperArm", "RightClavicle": "RightUpperArm", "Neck": "Head"}
