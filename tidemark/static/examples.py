"""A bad and a good script for each static rule: the rule fires on the one and nothing on the other."""

from __future__ import annotations

HEAD = "import pandas as pd\nframe = pd.read_parquet('rows')\ngoal = frame.pop('goal')\n"
SPLIT = "from sklearn.model_selection import train_test_split\na_train, a_test, b_train, b_test = train_test_split(frame, goal, random_state=3)\n"
SVM = "from sklearn.svm import SVC\nfrom sklearn.model_selection import GridSearchCV\nhunt = GridSearchCV(SVC(), {'C': [1, 9]})\n"
CV = "from sklearn.model_selection import cross_val_score\nfrom sklearn.linear_model import Ridge\n"
SCALE = "from sklearn.preprocessing import MinMaxScaler\nmm = MinMaxScaler()\n"

EXAMPLES: dict[str, tuple[str, str]] = {
    "P001": (HEAD + SCALE + "flat = mm.fit_transform(frame)\n" + SPLIT.replace("frame,", "flat,"), HEAD + SPLIT + SCALE + "flat = mm.fit_transform(a_train)\nflat2 = mm.transform(a_test)\n"),
    "S001": (HEAD + SCALE + "mm.fit(frame)\n" + SPLIT, HEAD + SPLIT + SCALE + "mm.fit(a_train)\n"),
    "P002": (HEAD + SPLIT + SCALE + "both = pd.concat([a_train, a_test])\nmm.fit(both)\n", HEAD + SPLIT + SCALE + "both = pd.concat([a_train, b_train])\nmm.fit(both)\n"),
    "P003": (HEAD + "from sklearn.impute import KNNImputer\nfill = KNNImputer()\nfull = fill.fit_transform(frame)\n" + SPLIT.replace("frame,", "full,"), HEAD + SPLIT + "from sklearn.impute import KNNImputer\nfill = KNNImputer()\nfull = fill.fit_transform(a_train)\n"),
    "S003": (HEAD + "from imblearn.over_sampling import ADASYN\nmore, goal2 = ADASYN(random_state=1).fit_resample(frame, goal)\n" + SPLIT.replace("frame, goal", "more, goal2"), HEAD + SPLIT + "from imblearn.over_sampling import ADASYN\nmore, goal2 = ADASYN(random_state=1).fit_resample(a_train, b_train)\n"),
    "S004": (HEAD + "from sklearn.feature_selection import SelectPercentile\npick = SelectPercentile()\nfew = pick.fit_transform(frame, goal)\n" + SPLIT.replace("frame,", "few,"), HEAD + SPLIT + "from sklearn.feature_selection import SelectPercentile\npick = SelectPercentile()\nfew = pick.fit_transform(a_train, b_train)\n"),
    "S002": (HEAD + "frame = frame.sort_values('event_date')\n" + SPLIT, HEAD + "frame = frame.sort_values('event_date')\n" + SPLIT.replace("random_state=3", "shuffle=False")),
    "C001": (HEAD + CV + SCALE + "flat = mm.fit_transform(frame)\nmarks = cross_val_score(Ridge(), flat, goal)\n", HEAD + CV + "from sklearn.pipeline import make_pipeline\nfrom sklearn.preprocessing import MinMaxScaler\nmarks = cross_val_score(make_pipeline(MinMaxScaler(), Ridge()), frame, goal)\n"),
    "C002": (HEAD + "from sklearn.model_selection import KFold\nwho = frame['customer_id']\nparts = KFold(4)\n", HEAD + "from sklearn.model_selection import GroupKFold\nwho = frame['customer_id']\nparts = GroupKFold(4)\n"),
    "C003": (HEAD + "from sklearn.model_selection import KFold\nframe['timestamp'] = pd.to_datetime(frame['timestamp'])\nparts = KFold(4)\n", HEAD + "from sklearn.model_selection import TimeSeriesSplit\nframe['timestamp'] = pd.to_datetime(frame['timestamp'])\nparts = TimeSeriesSplit(4)\n"),
    "C004": (HEAD + SPLIT + SVM + "hunt.fit(a_test, b_test)\n", HEAD + SPLIT + SVM + "hunt.fit(a_train, b_train)\n"),
    "C005": (HEAD + SVM + "hunt.fit(frame, goal)\nprint(hunt.best_score_)\n", HEAD + SVM + CV + "marks = cross_val_score(hunt, frame, goal)\nprint(marks.mean(), marks.std())\n"),
    "C006": ("import pandas as pd\nframe = pd.read_parquet('rows')\nframe['enc'] = frame.groupby('town')['target'].transform('mean')\n", "import pandas as pd\nframe = pd.read_parquet('rows')\nframe['enc'] = frame.groupby('town')['rain'].transform('mean')\n"),
    "M002": (HEAD + SPLIT + "from sklearn.metrics import roc_curve\nx, y, z = roc_curve(b_test, a_test)\nmy_threshold = z[y.argmax()]\n", HEAD + SPLIT + "from sklearn.metrics import roc_curve\nx, y, z = roc_curve(b_train, a_train)\nmy_threshold = z[y.argmax()]\n"),
    "M003": (HEAD + CV + "marks = cross_val_score(Ridge(), frame, goal)\nprint(marks.mean())\n", HEAD + CV + "marks = cross_val_score(Ridge(), frame, goal)\nprint(marks.mean(), marks.std())\n"),
    "M004": (HEAD + SPLIT + "from sklearn.metrics import f1_score\nprint(f1_score(b_train, a_train))\n", HEAD + SPLIT + "from sklearn.metrics import f1_score\nprint(f1_score(b_train, a_train), f1_score(b_test, a_test))\n"),
    "R001": (HEAD + SPLIT.replace(", random_state=3", ""), HEAD + SPLIT),
    "R002": ("import torch\nnet = torch.nn.Linear(2, 2)\n", "import torch\ntorch.manual_seed(4)\ntorch.use_deterministic_algorithms(True)\nnet = torch.nn.Linear(2, 2)\n"),
    "T002": (HEAD + SPLIT + "from xgboost import XGBRegressor\nnet = XGBRegressor(random_state=0)\nnet.fit(a_train, b_train, eval_set=[(a_test, b_test)])\n", HEAD + SPLIT + "from xgboost import XGBRegressor\nnet = XGBRegressor(random_state=0)\nnet.fit(a_train, b_train, eval_set=[(a_train, b_train)])\n"),
    "T003": (HEAD + CV + "top = 0\nfor seed in range(9):\n    mark = cross_val_score(Ridge(random_state=seed), frame, goal)\n    top = max(top, mark[0])\n", HEAD + CV + "marks = []\nfor seed in range(9):\n    marks.append(cross_val_score(Ridge(random_state=seed), frame, goal))\n"),
    "TM002": ("import pandas as pd\nframe = pd.read_parquet('rows')\nframe['next_price'] = frame['price'].shift(-2)\n", "import pandas as pd\nframe = pd.read_parquet('rows')\nframe['last_price'] = frame['price'].shift(2)\nframe['target'] = frame['price'].shift(-1)\n"),
}
