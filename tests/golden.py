"""Ten evaluated pairs with the scores they must get.

Each row is (schema, complexity, template of the generated SQL, score, reference SQL).
"""

GOLDEN = [
    ("hr_system", "complex", "list", 0.0,
     "WITH last_reviews AS (SELECT employee_id, MAX(reviewed_at) AS last_reviewed FROM hr.performance_reviews GROUP BY employee_id) SELECT e.name, EXTRACT(EPOCH FROM (NOW() - COALESCE(lr.last_reviewed, e.hire_date))) / 3600 AS hours_since_last_review FROM hr.employees e LEFT JOIN last_reviews lr ON e.id = lr.employee_id WHERE lr.last_reviewed IS NULL OR EXTRACT(QUARTER FROM lr.last_reviewed) < EXTRACT(QUARTER FROM NOW());"),
    ("ecommerce", "moderate", "default", 0.0156,
     "WITH avg_order_value AS (SELECT AVG(total) AS avg_total FROM orders) SELECT DISTINCT u.id, u.name FROM users u JOIN orders o ON u.id = o.user_id WHERE o.total > (SELECT avg_total FROM avg_order_value);"),
    ("fintech", "moderate", "aggregate", 0.0102,
     "SELECT a.id, SUM(t.amount) FROM fintech.accounts a JOIN fintech.transactions t ON a.id = t.account_id WHERE a.closed_at IS NOT NULL AND t.occurred_at < a.closed_at GROUP BY a.id;"),
    ("fintech", "highly_complex", "aggregate", 0.0096,
     "WITH filtered_loans AS (SELECT account_id FROM fintech.loans WHERE status = 'paid_off'), filtered_accounts AS (SELECT id, balance FROM fintech.accounts WHERE balance > 500) SELECT AVG(fa.balance) AS average_balance FROM filtered_accounts fa JOIN filtered_loans fl ON fa.id = fl.account_id;"),
    ("hr_system", "moderate", "list", 0.0021,
     "SELECT d.name, COALESCE(m.name, 'No Manager') FROM hr.departments d LEFT JOIN hr.employees m ON d.manager_id = m.id;"),
    ("healthcare", "complex", "default", 0.0051,
     "WITH patient_appointments AS (SELECT p.id, p.name, a.appointment_type, p.name, a.provider_id FROM healthcare.patients p JOIN healthcare.appointments a ON p.id = a.patient_id JOIN healthcare.diagnoses d ON a.id = d.appointment_id WHERE d.description ILIKE '%condition%') SELECT pa.appointment_type, pa.provider_id, COUNT(pa.appointment_type) AS num_occurrences FROM patient_appointments pa GROUP BY pa.appointment_type, pa.provider_id ORDER BY num_occurrences DESC;"),
    ("ecommerce", "highly_complex", "default", 0.0142,
     "SELECT u.tier, AVG(o.total) AS avg_order_value FROM orders o JOIN users u ON o.user_id = u.id WHERE o.status = 'delivered' GROUP BY u.tier;"),
    ("ecommerce", "moderate", "list", 0.0017,
     "SELECT p.name, SUM(oi.quantity) AS total_quantity FROM order_items oi JOIN products p ON oi.product_id = p.id WHERE p.category != 'electronics' GROUP BY p.name ORDER BY total_quantity DESC LIMIT 5;"),
    ("saas_analytics", "highly_complex", "default", 0.0169,
     "SELECT plan, AVG(EXTRACT(DAY FROM churned_at - created_at)) AS avg_days FROM saas.organizations WHERE churned_at IS NOT NULL GROUP BY plan;"),
    ("ecommerce", "moderate", "aggregate", 0.046,
     "SELECT u.name, COUNT(o.id) AS total_orders FROM orders o JOIN users u ON o.user_id = u.id GROUP BY u.name;"),
]

# Mean score per group: (level, value) -> (rows, mean).
GOLDEN_MEANS = {
    ("overall", None): (10, 0.01214),
    ("schema_name", "ecommerce"): (4, 0.019375),
    ("schema_name", "fintech"): (2, 0.0099),
    ("schema_name", "hr_system"): (2, 0.00105),
    ("schema_name", "healthcare"): (1, 0.0051),
    ("schema_name", "saas_analytics"): (1, 0.0169),
    ("complexity", "moderate"): (5, 0.01512),
    ("complexity", "highly_complex"): (3, 0.013567),
    ("complexity", "complex"): (2, 0.00255),
}
